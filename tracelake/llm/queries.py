"""The registered queries of the operators, over their whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import (
    byte_bpe,
    filter_audit,
    html_layout,
    maglev,
    minhash_hamming,
    prefix_trie,
    rank_profiles,
    rule_forest,
    sphere_caps,
    suffix_buckets,
    swap_packing,
    toxicity_mil,
    warc_zstd,
)
from tracelake.llm.common import table, written


def op10_tiktoken_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text, then decode its ids."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode_documents(table(spark, sf_dir, "documents"), path)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(byte_bpe.decode(F.col("ids"), path), 256).alias("decoded_sha256"),
    )


SHARDS = [f"shard-{k:02d}" for k in range(16)]


def op1_sphere_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and link counts of embeddings with cosine 0.95 or more."""
    return sphere_caps.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_maglev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return maglev.place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op3_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose five-word shingles agree to 85 %."""
    return minhash_hamming.near_duplicates(table(spark, sf_dir, "documents"))


def op4_suffix_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove every 400-byte string that starts at two places."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    size = lambda span: span["end"] - span["begin"]
    removed = F.aggregate("cut.spans", F.lit(0).cast("long"), lambda total, s: total + size(s))
    return suffix_buckets.remove_repeats(docs).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("cut.spans").cast("long").alias("n_spans"),
        F.sha2("cut.kept", 256).alias("kept_sha256"),
    )


def op5_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return html_layout.extract(table(spark, sf_dir, "pages"))


def op6_rule_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every document by fixed rules and an isolation forest."""
    stats = written(rule_forest.statistics(table(spark, sf_dir, "documents")), "rules")
    forests = rule_forest.fit(stats, table(spark, sf_dir, "labels"))
    return rule_forest.score(stats, forests).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op7_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page and read the archives back."""
    read = warc_zstd.read_archives(warc_zstd.archive(spark, table(spark, sf_dir, "pages")))
    return read.select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op8_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document with a model taught by the rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    remainder = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 5
    model = toxicity_mil.fit(docs, labels, remainder("id") != 0)
    return toxicity_mil.score(docs, model).select(
        "doc_id",
        (remainder("doc_id") == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_sentences",
        F.size("offending").cast("long").alias("n_offending"),
    )


def op9_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack every document into sequences of 2048 tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents")
    pieces = swap_packing.tokenize(docs, path, keep_ids=False)
    return swap_packing.pack(pieces)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How five filters interact in every order, from a stream over the documents' files."""
    return filter_audit.audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


def op12_rank_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by profiles of the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    profiles = rank_profiles.learn(docs.filter(remainder != 1))
    held_out = F.coalesce(remainder == 1, F.lit(False)).alias("held_out")
    judged = docs.select("doc_id", held_out, rank_profiles.identify(F.col("text"), profiles).alias("judged"))
    return judged.select("doc_id", "held_out", "judged.lang_pred", "judged.score")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of conversations that share beginnings within groups of five."""
    convs = written(prefix_trie.sequences(table(spark, sf_dir, "conversations")), "sequences")
    base = F.col("conv_id") - F.col("conv_id") % 5
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    return prefix_trie.trie(prefix_trie.graft(convs, base, head, most=8))


QUERIES = {
    "op1_sphere_caps": op1_sphere_caps,
    "op2_maglev": op2_maglev,
    "op3_minhash_hamming": op3_minhash_hamming,
    "op4_suffix_buckets": op4_suffix_buckets,
    "op7_warc_zstd": op7_warc_zstd,
    "op5_html_layout": op5_html_layout,
    "op6_rule_forest": op6_rule_forest,
    "op8_toxicity_mil": op8_toxicity_mil,
    "op9_swap_packing": op9_swap_packing,
    "op10_tiktoken_bpe": op10_tiktoken_bpe,
    "op11_filter_audit": op11_filter_audit,
    "op12_rank_profiles": op12_rank_profiles,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE: dict[str, str] = {
    "op1_sphere_caps": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a, v AS b
            WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
        ), r AS (
            SELECT vec_id AS a, vec_id AS b FROM v
            UNION
            SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
        ), c AS (
            SELECT a, min(b) AS component_id FROM r GROUP BY a
        )
        SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id)::BIGINT AS n_links,
               component_id, vec_id = component_id AS kept
        FROM v JOIN c ON c.a = vec_id
    """,
    # The table is filled turn by turn: state is the claimed slots, in order of their claims.
    "op2_maglev": """
        WITH RECURSIVE s AS (
            SELECT k, 'shard-' || lpad(k::VARCHAR, 2, '0') AS shard FROM range(16) AS t(k)
        ), p AS (
            SELECT k, shard, ('0x' || md5(shard || '/offset')[1:15])::BIGINT % 1621 AS first,
                   ('0x' || md5(shard || '/step')[1:15])::BIGINT % 1620 + 1 AS step
            FROM s
        ), o AS (
            SELECT k, list((first + j * step) % 1621 ORDER BY j) AS wish
            FROM p, range(1621) AS t(j) GROUP BY k
        ), f AS (
            SELECT 0 AS n, [false FOR x IN range(1621)] AS taken, NULL::BIGINT AS slot
            UNION ALL
            SELECT n + 1, [t OR i - 1 = c FOR t, i IN taken], c
            FROM (
                SELECT n, taken, list_filter(wish, lambda w: NOT taken[w + 1])[1] AS c
                FROM f JOIN o ON o.k = n % 16 WHERE n < 1621
            )
        )
        SELECT doc_id, f.slot, s.shard
        FROM documents
        JOIN f ON f.slot = ('0x' || md5('k' || doc_id::VARCHAR)[1:15])::BIGINT % 1621
        JOIN s ON s.k = (f.n - 1) % 16
    """,
    # Words and shingles are compared by 64-bit hashes.
    "op3_minhash_hamming": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ), s AS MATERIALIZED (
            SELECT doc_id, unnest(list_distinct(CASE
                WHEN len(words) >= 5 THEN
                    list_transform(range(1, len(words) - 3), lambda i: hash(words[i:i + 4]))
                WHEN len(words) > 0 THEN [hash(words)] ELSE []::UBIGINT[] END)) AS shingle
            FROM w
        ), n AS MATERIALIZED (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), l AS MATERIALIZED (
            SELECT c.a, c.b FROM (
                SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
                FROM s AS x JOIN s AS y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
                GROUP BY x.doc_id, y.doc_id
            ) AS c JOIN n AS x ON x.doc_id = c.a JOIN n AS y ON y.doc_id = c.b
            WHERE 100 * common >= 85 * (x.n + y.n - common)
        ), r AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION
            SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
        )
        SELECT r.a AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id,
               r.a = min(r.b) AS kept
        FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
    """,
    # Windows are substrings of the bytes' hexadecimal text, compared by 64-bit hashes.
    "op4_suffix_buckets": r"""
        WITH d AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
        ), w AS MATERIALIZED (
            SELECT doc_id, p, hash(substr(h, 2 * p + 1, 800)) AS m
            FROM (SELECT doc_id, h, unnest(range(n - 399)) AS p FROM d WHERE n >= 400)
        ), g AS (
            SELECT m FROM w GROUP BY m HAVING count(*) > 1
        ), t AS (
            SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 400, true) AS fresh
            FROM w WHERE m IN (SELECT m FROM g)
        ), u AS (
            SELECT doc_id, run, min(p) AS a, max(p) + 400 AS b
            FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM t)
            GROUP BY doc_id, run
        ), k AS (
            SELECT doc_id, sum(b - a) AS removed, count(*) AS spans,
                   string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a)
                   || substr(any_value(h), 2 * max(b) + 1) AS kept
            FROM (SELECT u.*, d.h, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before
                  FROM u JOIN d USING (doc_id))
            GROUP BY doc_id
        )
        SELECT doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed,
               coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)
    """,
    "op7_warc_zstd": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS h FROM pages
        ), f AS (
            SELECT *, strlen(h) AS n, min(page_id) OVER (PARTITION BY h) AS first FROM p
        )
        SELECT page_id, n::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
               CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f
    """,
    "op11_filter_audit": r"""
        WITH w AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ), d AS MATERIALIZED (
            SELECT doc_id, part, [
                       len(words) < 100,
                       100 * len(list_distinct(words)) < 80 * len(words),
                       100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t),
                       regexp_matches(t, '[#$%&*|]'),
                       coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)
                   ] AS fails,
                   doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
                   doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic
            FROM w
        ), g AS (
            SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
            FROM d GROUP BY ALL
        ), o AS (
            SELECT [a, b, c, d, e] AS o FROM range(1, 6) t(a), range(1, 6) t2(b), range(1, 6) t3(c), range(1, 6) t4(d),
                   range(1, 6) t5(e) WHERE len(list_distinct([a, b, c, d, e])) = 5
        ), s AS (
            SELECT part, good, toxic, n, array_to_string(list_transform(o, lambda x: chr(64 + x::INT)), '') AS filter_order,
                   step, o[step] AS own, fails[o[step]] AS failing,
                   len(list_filter(o[:step - 1], lambda x: fails[x])) > 0 AS gone,
                   len(list_filter(fails, lambda f: f)) = 1 AS alone
            FROM g, o, range(1, 6) AS t(step)
        ), r AS (
            SELECT part, filter_order, step::INT AS step, own,
                   coalesce(sum(n) FILTER (NOT failing AND NOT gone), 0)::BIGINT AS kept,
                   coalesce(sum(n) FILTER (failing AND NOT gone), 0)::BIGINT AS removed,
                   coalesce(sum(n) FILTER (failing AND gone), 0)::BIGINT AS redundant,
                   coalesce(sum(n) FILTER (failing AND alone), 0)::BIGINT AS unique_fails,
                   coalesce(sum(n) FILTER (failing AND NOT gone AND good), 0)::BIGINT AS good_lost,
                   coalesce(sum(n) FILTER (failing AND NOT gone AND toxic), 0)::BIGINT AS toxic_lost
            FROM s GROUP BY part, filter_order, step, own
        )
        SELECT * EXCLUDE own, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
    """,
    # CRC-32 bit by bit; a node is the list of its turns' SHA-256.
    "op13_prefix_trie": r"""
        WITH RECURSIVE t AS (
            SELECT conv_id, turn, strlen(coalesce(text, '')) AS size,
                   sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS d
            FROM conversations WHERE conv_id IS NOT NULL
        ), c AS MATERIALIZED (
            SELECT conv_id, list({'d': d, 'size': size} ORDER BY turn NULLS FIRST, d) AS turns FROM t GROUP BY conv_id
        ), h AS MATERIALIZED (
            SELECT conv_id, xor(list_reduce(
                [4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                lambda crc, byte: list_reduce(
                    [xor(crc, byte)] || list_transform(range(8), lambda k: k::BIGINT),
                    lambda p, k: CASE WHEN p & 1 = 1 THEN xor(p >> 1, 3988292384) ELSE p >> 1 END)
            ), 4294967295) % 9 AS h FROM c
        ), r AS MATERIALIZED (
            SELECT c.conv_id, coalesce(b.turns, [])[:h] || c.turns[h + 1:] AS turns
            FROM c JOIN h USING (conv_id) LEFT JOIN c AS b ON b.conv_id = c.conv_id - c.conv_id % 5
        ), m AS MATERIALIZED (
            SELECT conv_id, depth, len(turns) = depth AS ends,
                   list_transform(turns[:depth], lambda x: x.d) AS node, turns[depth].size AS size
            FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM r)
        ), n AS MATERIALIZED (
            SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(size), 0) AS size,
                   coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ends
            FROM m GROUP BY node, depth
        ), k AS MATERIALIZED (
            SELECT n.node, n.depth, n.n_convs, n.size, count(child.node) AS n_children
            FROM n LEFT JOIN n AS child ON child.depth = n.depth + 1 AND child.node[:n.depth] = n.node
            GROUP BY ALL
        ), u AS (
            SELECT node[:up] AS node, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * size) AS saved
            FROM (SELECT *, unnest(range(depth + 1)) AS up FROM k) GROUP BY ALL
        )
        SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
               k.n_children::BIGINT AS n_children, u.n_leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens,
               sha256(n.ends) AS ends_sha256
        FROM n JOIN k ON k.node = n.node JOIN u ON u.node = n.node
        LEFT JOIN n AS p ON n.depth > 0 AND p.node = n.node[:n.depth - 1] AND p.depth = n.depth - 1
    """,
}
