"""SQL over the same tables for every registered query, for an independent check.

The statements are composed from named common table expressions written the direct
way (dense grids, left joins, whole-table windows), unlike the operators they check.
"""

from __future__ import annotations

import re

from tracelake.config import CHANNEL_NAMES, FEATURES
from tracelake.functions.expressions import (
    CENTRAL_DEN,
    CENTRAL_NUM,
    NORMAL_CLIP,
    TAIL_DEN,
    TAIL_NUM,
)

def _horner(coefficients, r: str) -> str:
    text = f"{coefficients[0]:.17e}"
    for c in coefficients[1:]:
        text = f"({text}) * {r} + {c:.17e}"
    return f"({text})"


def normal_quantile_sql(p: str) -> str:
    """Inverse normal CDF of the SQL expression ``p``, clipped to +-NORMAL_CLIP."""
    q = f"(({p}) - 5e-1)"
    r0 = f"(1.80625e-1 - {q} * {q})"
    central = f"{_horner(CENTRAL_NUM, r0)} * {q} / {_horner(CENTRAL_DEN, r0)}"
    tail_p = f"(CASE WHEN {q} < 0e0 THEN ({p}) ELSE 1e0 - ({p}) END)"
    r1 = f"(sqrt(-ln({tail_p})) - 1.6e0)"
    tail = f"{_horner(TAIL_NUM, r1)} / {_horner(TAIL_DEN, r1)}"
    clip_text = f"{NORMAL_CLIP:.17e}"
    return (
        f"CASE WHEN ({p}) IS NULL THEN NULL "
        f"WHEN ({p}) < 1e-9 THEN -{clip_text} "
        f"WHEN ({p}) > 1e0 - 1e-9 THEN {clip_text} "
        f"WHEN abs({q}) <= 4.25e-1 THEN {central} "
        f"ELSE greatest(-{clip_text}, least({clip_text}, "
        f"(CASE WHEN {q} < 0e0 THEN -1e0 ELSE 1e0 END) * {tail})) END"
    )


C: dict[str, str] = {}

# ── events: samples, gates, resampling ──────────────────────────────────────
C["tel"] = """
SELECT CAST(user_id AS VARCHAR) AS job_id, event_type AS node_id, event_id AS seq,
       epoch_us(ts) / 1e6 AS ts, CAST(event_id % 101 AS DOUBLE) AS u,
       CAST(regexp_extract(props, '"k": ?([0-9]+)', 1) AS DOUBLE) AS m,
       value * 16.0 AS b, value AS w
FROM events"""
C["probe"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, node_id ORDER BY seq) AS rn FROM tel)
WHERE rn <= 10"""
C["node"] = """
SELECT *, coalesce(est BETWEEN 100000 AND 250000, false) AS usable FROM (
  SELECT job_id, node_id, max(CASE WHEN rn = 1 THEN ts END) AS first_ts,
         CASE WHEN count(DISTINCT ts) >= 2 THEN (max(ts) - min(ts)) / (count(DISTINCT ts) - 1) END AS est
  FROM probe GROUP BY job_id, node_id)"""
C["gate"] = """
SELECT *, CASE WHEN t0 IS NULL THEN 'no_readable_t0'
               WHEN used / total < 0.75 THEN 'low_node_ratio:' || used || '/' || total
               WHEN used = 0 THEN 'no_usable_nodes' END AS reason
FROM (SELECT job_id, count(*) AS total, count(*) FILTER (WHERE usable) AS used, min(first_ts) AS t0
      FROM node GROUP BY job_id)"""
C["loc"] = """
SELECT t.job_id, t.node_id, t.ts, CAST(floor((t.ts - g.t0) / 3600.0 + 1e-12) AS BIGINT) AS k,
       t.u, t.m, t.b, t.w
FROM tel t JOIN node n ON n.job_id = t.job_id AND n.node_id = t.node_id AND n.usable
JOIN gate g ON g.job_id = t.job_id AND g.reason IS NULL
WHERE t.ts IS NOT NULL"""
C["roll"] = """
SELECT job_id, node_id, ts, k, avg(u) AS u, avg(m) AS m, coalesce(sum(b), 0) AS b, coalesce(sum(w), 0) AS w
FROM loc GROUP BY job_id, node_id, ts, k"""
C["bins"] = """
SELECT job_id, node_id, k, avg(u) AS u, avg(m) AS m, avg(b) AS b, avg(w) AS w
FROM roll GROUP BY job_id, node_id, k"""
C["ngrid"] = """
SELECT job_id, node_id, unnest(generate_series(lo, hi)) AS k
FROM (SELECT job_id, node_id, min(k) AS lo, max(k) AS hi FROM bins GROUP BY job_id, node_id)"""
_FF = ", ".join(
    f"last_value({c} IGNORE NULLS) OVER (PARTITION BY job_id, node_id ORDER BY k "
    f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in "umbw"
)
C["nfill"] = f"""
SELECT job_id, node_id, k, {_FF}
FROM (SELECT g.job_id, g.node_id, g.k, b.u, b.m, b.b, b.w FROM ngrid g
      LEFT JOIN bins b ON b.job_id = g.job_id AND b.node_id = g.node_id AND b.k = g.k)"""
C["crossed"] = """
SELECT job_id, k, avg(u) AS u, avg(m) AS m, coalesce(sum(b), 0) AS b, coalesce(sum(w), 0) AS w
FROM nfill WHERE k >= 0 GROUP BY job_id, k"""
C["jgrid"] = """
SELECT job_id, unnest(generate_series(0, hi)) AS k
FROM (SELECT job_id, max(k) AS hi FROM crossed GROUP BY job_id)"""
_BF = ", ".join(
    f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY k "
    f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
    f"first_value({c} IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY k "
    f"ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS {c}" for c in "umbw"
)
C["jfill"] = f"""
SELECT job_id, k, {_BF}
FROM (SELECT g.job_id, g.k, c.u, c.m, c.b, c.w FROM jgrid g
      LEFT JOIN crossed c ON c.job_id = g.job_id AND c.k = g.k)"""
_CAST = ", ".join(
    f"CAST({s} AS FLOAT) AS {n}" for s, n in zip("umbw", CHANNEL_NAMES)
)
C["trace"] = f"SELECT job_id, k, k * 3600.0::DOUBLE AS timestamp, {_CAST} FROM jfill"
C["outcome"] = """
SELECT g.job_id, g.total, g.used, l.k_max,
       CASE WHEN g.reason IS NOT NULL THEN g.reason WHEN l.k_max < 0 THEN 'neg_kmax' END AS reason
FROM gate g LEFT JOIN (SELECT job_id, max(k) AS k_max FROM loc GROUP BY job_id) l ON l.job_id = g.job_id"""
C["eidx"] = """
SELECT * FROM (
  SELECT job_id, CAST(used AS INTEGER) AS nodes_used, 'traces/' || job_id AS file_path,
         k_max + 1 AS length, round(k_max * 3600.0::DOUBLE, 3) AS duration_sec, 3600.0::DOUBLE AS delta_t
  FROM outcome WHERE reason IS NULL AND k_max IS NOT NULL)
WHERE duration_sec BETWEEN 2400000 AND 2580000"""

# ── orders, lineitem: scheduler records and the large index ─────────────────
C["sched"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS job_id, o_custkey % 128 + 1 AS cpus_req,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 2e9 ELSE round(o_totalprice) END AS mem_req,
       o_totalprice / 20.0::DOUBLE AS priority,
       CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 5 WHEN 'P' THEN 1 END AS state,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'LLSUB:BATCH' WHEN '2-HIGH' THEN 'LLSUB:INTERACTIVE'
            WHEN '3-MEDIUM' THEN 'LLMAPREDUCE:MAP' WHEN '4-NOT SPECIFIED' THEN 'OTHER'
            WHEN '5-LOW' THEN 'UNKNOWN' END AS job_type,
       epoch_us(o_orderdate) // 1000000 + o_orderkey % 86400 AS time_start
FROM orders"""
C["lraw"] = """
SELECT CAST(l_orderkey AS VARCHAR) AS job_id, CAST(count(DISTINCT l_suppkey) AS INTEGER) AS nodes_used,
       'traces/' || l_orderkey AS file_path, CAST(sum(l_quantity) * 100 AS BIGINT) AS length,
       round((CAST(sum(l_quantity) * 100 AS BIGINT) - 1) * 0.103::DOUBLE, 3) AS duration_sec
FROM lineitem GROUP BY l_orderkey"""


def _feature_chain(p: str, index: str) -> None:
    """CTEs ``{p}join`` .. ``{p}feat`` over one trace index."""
    C[f"{p}join"] = f"""
SELECT s.*, i.file_path, i.nodes_used AS nodes_req, i.duration_sec, i.length
FROM sched s JOIN ({index}) i ON i.job_id = s.job_id"""
    C[f"{p}in"] = f"""
SELECT *, CASE WHEN mem_req >= 1e9 THEN 1 ELSE 0 END AS mem_unlimited,
       CASE WHEN mem_req < 1e9 THEN mem_req END AS mem_known,
       log2(cpus_req + 1.0::DOUBLE) AS cpus_log, ln(1 + duration_sec) AS duration_log,
       CASE WHEN priority > 0 THEN log10(priority) END AS priority_log,
       CAST(nodes_req AS DOUBLE) AS nodes_x
FROM {p}join"""
    for name, column, n in (
        ("mem", "mem_known", 500), ("cpus", "cpus_log", 200),
        ("dur", "duration_log", 1000), ("pri", "priority_log", 500), ("nod", "nodes_x", 100),
    ):
        _quantile_chain(f"{p}{name}", f"{p}in", column, n)
    C[f"{p}feat"] = f"""
SELECT j.job_id, j.file_path, j.nodes_req, j.duration_sec, j.length,
  sin(2 * pi() * h / 24) AS hour_sin, cos(2 * pi() * h / 24) AS hour_cos,
  sin(2 * pi() * dw / 7) AS dow_sin, cos(2 * pi() * dw / 7) AS dow_cos,
  sin(2 * pi() * dm / 31) AS dom_sin, cos(2 * pi() * dm / 31) AS dom_cos,
  mem_unlimited, coalesce(zm.z, 0) AS mem_req_scaled,
  CASE WHEN nodes_req = 1 THEN 1 ELSE 0 END AS nodes_req_is_one,
  CASE WHEN nodes_req > 1 THEN log2(nodes_req) / 8 ELSE 0 END AS nodes_req_log,
  zc.z AS cpus_req_scaled, zd.z AS duration_scaled, zp.z AS priority_scaled,
  CASE WHEN priority < 11000 THEN 0 WHEN priority < 20000 THEN 1 ELSE 2 END AS tier,
  CASE WHEN tier = 0 THEN 1 ELSE 0 END AS ptier_0, CASE WHEN tier = 1 THEN 1 ELSE 0 END AS ptier_1,
  CASE WHEN tier = 2 THEN 1 ELSE 0 END AS ptier_2,
  CASE WHEN job_type = 'LLSUB:BATCH' THEN 1 ELSE 0 END AS type_batch,
  CASE WHEN job_type = 'LLSUB:INTERACTIVE' THEN 1 ELSE 0 END AS type_interactive,
  CASE WHEN job_type = 'LLMAPREDUCE:MAP' THEN 1 ELSE 0 END AS type_map,
  CASE WHEN job_type = 'OTHER' THEN 1 ELSE 0 END AS type_other,
  CASE WHEN state IN (3, 4, 5, 6, 11) THEN 0 ELSE 1 END AS state_other,
  CASE WHEN state = 3 THEN 1 ELSE 0 END AS state_3, CASE WHEN state = 4 THEN 1 ELSE 0 END AS state_4,
  CASE WHEN state = 5 THEN 1 ELSE 0 END AS state_5, CASE WHEN state = 6 THEN 1 ELSE 0 END AS state_6,
  CASE WHEN state = 11 THEN 1 ELSE 0 END AS state_11
FROM (SELECT *, extract(hour FROM t) + extract(minute FROM t) / 60.0::DOUBLE AS h,
             isodow(t) - 1 AS dw, day(t) - 1 AS dm
      FROM (SELECT *, make_timestamp(time_start * 1000000) AS t FROM {p}in)) j
LEFT JOIN {p}mem_z zm ON zm.job_id = j.job_id LEFT JOIN {p}cpus_z zc ON zc.job_id = j.job_id
LEFT JOIN {p}dur_z zd ON zd.job_id = j.job_id LEFT JOIN {p}pri_z zp ON zp.job_id = j.job_id"""
    C[f"{p}usable"] = f"""
SELECT * FROM {p}feat WHERE length > 0 AND {" AND ".join(f"{c} IS NOT NULL AND isfinite(CAST({c} AS DOUBLE))" for c in FEATURES)}
  AND duration_sec IS NOT NULL"""


def _quantile_chain(p: str, source: str, column: str, n: int) -> None:
    """``{p}_q``: exact-position quantiles; ``{p}_z``: normal score per job."""
    C[f"{p}_s"] = f"""
SELECT {column} AS v, row_number() OVER (ORDER BY {column}) - 1 AS rk, count(*) OVER () AS nn
FROM {source} WHERE {column} IS NOT NULL"""
    C[f"{p}_pos"] = f"""
SELECT i, n, nn, i * (nn - 1) // greatest(n - 1, 1) AS lo,
       (i * (nn - 1) % greatest(n - 1, 1)) / CAST(greatest(n - 1, 1) AS DOUBLE) AS f
FROM (SELECT unnest(generate_series(0, n - 1)) AS i, n, nn
      FROM (SELECT DISTINCT least({n}, nn) AS n, nn FROM {p}_s))"""
    C[f"{p}_q"] = f"""
SELECT p.i, p.n, a.v + p.f * (coalesce(b.v, a.v) - a.v) AS q
FROM {p}_pos p JOIN {p}_s a ON a.rk = p.lo LEFT JOIN {p}_s b ON b.rk = p.lo + 1"""
    C[f"{p}_x"] = f"""
SELECT x, count(*) FILTER (WHERE q < x) AS below, count(*) FILTER (WHERE q <= x) AS upto,
       max(q) FILTER (WHERE q < x) AS ql, min(q) FILTER (WHERE q > x) AS qr,
       min(q) AS q0, max(q) AS q1, max(n) AS n
FROM (SELECT DISTINCT {column} AS x FROM {source} WHERE {column} IS NOT NULL) CROSS JOIN {p}_q GROUP BY x"""
    C[f"{p}_p"] = f"""
SELECT x, CAST(CASE WHEN x - 1e-7 < q0 THEN 0 WHEN x + 1e-7 > q1 THEN 1
       WHEN upto > below THEN (below + upto - 1) / 2.0::DOUBLE / (n - 1)
       ELSE (below - 1 + (x - ql) / (qr - ql)) / (n - 1) END AS DOUBLE) AS p
FROM {p}_x"""
    C[f"{p}_z"] = f"""
SELECT s.job_id, {normal_quantile_sql("p.p")} AS z
FROM {source} s JOIN {p}_p p ON p.x = s.{column}"""


_feature_chain("l", "SELECT * FROM lraw WHERE duration_sec BETWEEN 300 AND 2000")
_feature_chain("e", "SELECT * FROM eidx")

# ── split, normalization, windows over the event jobs ───────────────────────
_SPLIT = """
SELECT *, CASE WHEN row_number() OVER (ORDER BY md5(job_id || '|42'), job_id)
               <= round_even((count(*) OVER ()) * 0.1::DOUBLE, 0) THEN 'test' ELSE 'train' END AS split
FROM {jobs}"""
C["lsplit"] = _SPLIT.format(jobs="lusable")
C["ejobs0"] = _SPLIT.format(jobs="eusable")
C["itrace"] = "SELECT t.* FROM trace t JOIN eidx i ON i.job_id = t.job_id"
C["ejobs"] = """
SELECT j.* EXCLUDE (length), t.length FROM ejobs0 j
JOIN (SELECT job_id, count(*) AS length FROM itrace GROUP BY job_id) t ON t.job_id = j.job_id"""
_LOGS = ", ".join(
    f"avg(ln(1 + {c}::DOUBLE)) AS m{i}, "
    f"sqrt(greatest(avg(ln(1 + {c}::DOUBLE) ** 2) - avg(ln(1 + {c}::DOUBLE)) ** 2, 1e-12)) AS s{i}"
    for i, c in ((2, "memory_used_MiB"), (3, "power_draw_W"))
)
C["stats"] = f"""
SELECT {_LOGS} FROM itrace WHERE job_id IN (SELECT job_id FROM ejobs WHERE split = 'train')"""
C["norm"] = """
SELECT job_id, k,
  CAST(greatest(-10, least(10, gpu_used_pct::DOUBLE / 100 * 2 - 1)) AS FLOAT) AS z0,
  CAST(greatest(-10, least(10, memory_used_pct::DOUBLE / 100 * 2 - 1)) AS FLOAT) AS z1,
  CAST(greatest(-10, least(10, (ln(1 + memory_used_MiB::DOUBLE) - m2) / s2)) AS FLOAT) AS z2,
  CAST(greatest(-10, least(10, (ln(1 + power_draw_W::DOUBLE) - m3) / s3)) AS FLOAT) AS z3
FROM itrace CROSS JOIN stats"""
C["chunk"] = """
SELECT split, job_id, unnest(generate_series(0, greatest(1, (length + 63) // 64) - 1)) AS chunk_idx
FROM ejobs"""
C["wkeys"] = "SELECT DISTINCT job_id, k // 64 AS chunk_idx FROM norm"
_D = "CAST(CAST(round(coalesce({c}, 0)::DOUBLE * 1e5) AS BIGINT) AS VARCHAR)"


def _cells(channels, prefix):
    return ", ".join(
        f"string_agg({_D.format(c=f'n.z{z}')}, ',' ORDER BY pos) AS {name}"
        for z, name in ((z, f"{prefix}{z}" if prefix != "target" else "target") for z in channels)
    )


C["wctx"] = f"""
SELECT c.job_id, c.chunk_idx, {_cells(range(4), "ctx")}
FROM (SELECT *, unnest(generate_series(0, 127)) AS pos FROM wkeys) c
LEFT JOIN norm n ON n.job_id = c.job_id AND n.k = c.chunk_idx * 64 - 128 + c.pos
GROUP BY c.job_id, c.chunk_idx"""
C["wfut"] = f"""
SELECT c.job_id, c.chunk_idx, {_cells(range(3), "future_aux")}, {_cells((3,), "target")},
  string_agg(CASE WHEN n.k IS NULL THEN '0' ELSE '1' END, '' ORDER BY pos) AS mask,
  count(n.k) AS n_real
FROM (SELECT *, unnest(generate_series(0, 63)) AS pos FROM wkeys) c
LEFT JOIN norm n ON n.job_id = c.job_id AND n.k = c.chunk_idx * 64 + c.pos
GROUP BY c.job_id, c.chunk_idx"""

# ── scoring and evaluation ──────────────────────────────────────────────────
C["capped"] = """
SELECT job_id, length, CAST(greatest(1, ceil(duration_sec / (64 * 3600.0::DOUBLE))) AS BIGINT) AS by_duration
FROM ejobs"""
C["plan"] = """
SELECT job_id, w, w * 64 AS start, least(64, total - w * 64) AS n_real FROM (
  SELECT job_id, total, unnest(generate_series(0, (total + 63) // 64 - 1)) AS w
  FROM (SELECT job_id, least(length, by_duration * 64) AS total FROM capped))"""
C["line"] = """
SELECT slope, (sy - slope * sx) / n AS intercept FROM (
  SELECT (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope, n, sx, sy FROM (
    SELECT count(*) AS n, sum(z0::DOUBLE) AS sx, sum(z3::DOUBLE) AS sy,
           sum(z0::DOUBLE * z0::DOUBLE) AS sxx, sum(z0::DOUBLE * z3::DOUBLE) AS sxy
    FROM norm WHERE job_id IN (SELECT job_id FROM ejobs WHERE split = 'train')))"""
C["pairs"] = """
SELECT n.job_id, n.k, n.z3::DOUBLE AS real_z, l.intercept + l.slope * n.z0::DOUBLE AS gen_z
FROM norm n JOIN plan p ON p.job_id = n.job_id AND n.k >= p.start AND n.k < p.start + p.n_real
JOIN ejobs j ON j.job_id = n.job_id AND j.split = 'test' CROSS JOIN line l"""
C["watts"] = """
SELECT job_id, k, exp(real_z * s3 + m3) - 1 AS real_w, exp(gen_z * s3 + m3) - 1 AS gen_w
FROM pairs CROSS JOIN stats"""


def _pearson(a: str, b: str, op: str, threshold: str) -> str:
    return (
        f"CASE WHEN stddev_pop({a}) {op} {threshold} AND stddev_pop({b}) {op} {threshold} "
        f"THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END"
    )


C["summary"] = f"""
SELECT job_id, {_pearson("real_w", "gen_w", ">=", "1e-9")} AS pearson_r,
       sqrt(avg((real_w - gen_w) ** 2)) AS rmse, avg(abs(real_w - gen_w)) AS mae, count(*) AS length,
       count(*) * 3600::DOUBLE / 60 AS duration_min
FROM watts GROUP BY job_id"""
C["pearz"] = f"""
SELECT job_id, {_pearson("real_z", "gen_z", ">", "1e-8")} AS pearson_r FROM pairs GROUP BY job_id"""


def compose(select: str) -> str:
    """The statement with every CTE it needs, in dependency order."""
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text):
            if name in C and name not in ordered and name not in visiting:
                visiting.add(name)
                need(C[name])
                ordered.append(name)

    visiting: set[str] = set()
    need(select)
    if not ordered:
        return select.strip()
    body = ",\n".join(f"{n} AS ({C[n].strip()})" for n in ordered)
    return f"WITH {body}\n{select.strip()}"


def _r(places: int, **names: str) -> str:
    return ", ".join(f"round(CAST({e} AS DOUBLE), {places}) AS {n}" for n, e in names.items())


_M = dict(util="u", mem_pct="m", mem_mib="b", watts="w")
_T = "job_id, k, " + _r(3, timestamp="timestamp", **{c: c for c in CHANNEL_NAMES})
_FEATURE_VIEW = "job_id, file_path, nodes_req, duration_sec, length, " + _r(
    6, **{c: c for c in (*FEATURES, "dom_sin", "dom_cos")}
)
_SUMMARY_VIEW = "job_id, length, " + _r(
    5, pearson_r="pearson_r", rmse="rmse", mae="mae", duration_min="duration_min"
)
_STRATUM = (
    "concat_ws('_', CAST(type_batch AS VARCHAR), CAST(type_interactive AS VARCHAR), "
    "CAST(type_map AS VARCHAR), CAST(type_other AS VARCHAR), CAST(nodes_req_is_one AS VARCHAR))"
)
C["lstrat"] = f"""
SELECT job_id, stratum, CASE WHEN rn <= least(n, greatest(1, round_even(n * 0.1::DOUBLE, 0)))
  THEN 'test' ELSE 'train' END AS split
FROM (SELECT job_id, stratum, count(*) OVER (PARTITION BY stratum) AS n,
        row_number() OVER (PARTITION BY stratum ORDER BY md5(job_id || '|42'), job_id) AS rn
      FROM (SELECT *, {_STRATUM} AS stratum FROM lusable))"""
_NUMERIC = ("nodes_req", "duration_sec", "length", *FEATURES, "dom_sin", "dom_cos")
C["cells"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, "
    f"{f'CAST({c} AS DOUBLE)' if c == 'duration_sec' else f'round(CAST({c} AS DOUBLE), 9)'} AS v "
    f"FROM lfeat WHERE {c} IS NOT NULL"
    for c in _NUMERIC
)
C["ranges"] = """
SELECT column_name, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo,
       CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi
FROM (SELECT column_name, min(v) AS lo, max(v) AS hi FROM cells GROUP BY column_name)"""


def _correlation() -> str:
    parts = []
    for i, a in enumerate(_NUMERIC):
        for b in _NUMERIC[: i + 1]:
            parts.append(
                f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN stddev_pop({a}) > 1e-12 AND "
                f"stddev_pop({b}) > 1e-12 THEN corr({a}, {b}) END AS r FROM lfeat"
            )
    return " UNION ALL ".join(parts)


def _epoch(world: int, batch: int, epoch: int, cap: str) -> str:
    return f"""
SELECT i % {world} AS rank, i // {world} // {batch} AS step, job_id, chunk_idx, i FROM (
  SELECT job_id, chunk_idx, count(*) OVER () AS n,
         row_number() OVER (ORDER BY md5(job_id || '|' || chunk_idx || '|42|{epoch}'), job_id, chunk_idx) - 1 AS i
  FROM chunk WHERE split = 'train')
WHERE i < {world} * (n // {world}) AND i // {world} // {batch} < least(n // {world} // {batch}, {cap})"""


def _score_carry() -> str:
    # c_w = sum over j < w of e_j * 2^(j - w), e_j the first channel at the end of window j.
    return """
SELECT n.job_id, n.k, round(0.5 * n.z0::DOUBLE + 0.5 * c.carry, 5) AS gen_z
FROM norm n JOIN (
  SELECT p.job_id, p.w, p.start, p.n_real,
         coalesce(sum(e.z0::DOUBLE * power(2.0, p.w)) OVER (
           PARTITION BY p.job_id ORDER BY p.w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
         * power(2.0, -p.w) AS carry
  FROM plan p JOIN norm e ON e.job_id = p.job_id AND e.k = p.start + p.n_real - 1
) c ON c.job_id = n.job_id AND c.w = n.k // 64 AND n.k < c.start + c.n_real"""


def _phase() -> str:
    finite = " AND ".join(
        f"{c} IS NOT NULL AND isfinite(CAST({c} AS DOUBLE))" for c in (*FEATURES, "duration_sec")
    )
    rows = (
        ("resample", "ok", "count(*) FROM outcome WHERE reason IS NULL"),
        ("resample", "failed", "count(*) FROM outcome WHERE reason IS NOT NULL"),
        ("load", "loaded", "count(*) FROM efeat"),
        ("load", "dropped_non_finite", f"count(*) FROM efeat WHERE NOT ({finite})"),
        ("load", "dropped_empty", f"count(*) FROM efeat WHERE {finite} AND length <= 0"),
        ("load", "kept", f"count(*) FROM efeat WHERE {finite} AND length > 0"),
        ("split", "train", "count(*) FROM ejobs WHERE split = 'train'"),
        ("split", "test", "count(*) FROM ejobs WHERE split = 'test'"),
        ("chunks", "train", "count(*) FROM chunk WHERE split = 'train'"),
        ("chunks", "test", "count(*) FROM chunk WHERE split = 'test'"),
    )
    return " UNION ALL ".join(
        f"SELECT '{p}' AS phase, '{m}' AS metric, v AS value FROM (SELECT {q.replace('count(*)', 'count(*) AS v', 1)})"
        for p, m, q in rows
    )


def _dirty() -> str:
    keep = dict(util=("u", 5, 3), mem_pct=("m", 7, 3), mem_mib=("b", 11, 3), watts=("w", 13, 3))
    cells = []
    for name, (c, mod, _) in keep.items():
        cells.append(f"count({c}) FILTER (WHERE seq % {mod} <> 0) AS n_{name}")
    for name, (c, mod, places) in keep.items():
        value = f"round({c}, 4)" if c in "bw" else c
        cells.append(f"round(sum({value}) FILTER (WHERE seq % {mod} <> 0), {places}) AS sum_{name}")
    return (
        f"SELECT job_id, node_id, count(*) AS n_rows, {', '.join(cells)} FROM tel "
        "WHERE seq % 17 <> 0 GROUP BY job_id, node_id"
    )


def _select(columns: str, source: str) -> str:
    return f"SELECT {columns} FROM {source}"


def _scaled(name: str, output: str) -> str:
    return (
        f"SELECT j.job_id, round(z.z, 6) AS {output} FROM lin j LEFT JOIN {name}_z z ON z.job_id = j.job_id"
    )


_STATEMENTS = {
    "csv_ingest": "SELECT job_id, node_id, row_number() OVER (PARTITION BY job_id, node_id ORDER BY seq) AS pos, "
    + _r(6, ts="ts", **_M) + " FROM tel",
    "tolerant_parse": _dirty(),
    "scheduler_csv": "SELECT job_id, cpus_req, mem_req, priority, state, job_type, time_start FROM sched",
    "trace_index_dedup": "SELECT DISTINCT job_id, file_path, nodes_used AS nodes_req, duration_sec, length FROM lraw",
    "trace_sink_roundtrip": _select(_T, "trace"),
    "trace_index": "SELECT job_id, nodes_used, file_path, length, duration_sec, delta_t FROM eidx",
    "packed_traces": "SELECT job_id, count(*) AS length, "
    + ", ".join(f"string_agg({_D.format(c=f'z{i}')}, ',' ORDER BY k) AS ch{i}" for i in range(4))
    + " FROM norm GROUP BY job_id",
    "split_sink_roundtrip": "SELECT split, job_id, chunk_idx FROM chunk",
    "pending_units": "SELECT url AS key FROM pages WHERE NOT (page_id % 3 = 0 AND length(html) >= 1000)",
    "fetch_plan": "SELECT url AS key, (row_number() OVER (ORDER BY url) - 1) // 20 AS batch_no, "
    "CASE WHEN page_id % 3 = 0 THEN 'skipped' ELSE 'downloaded' END AS status FROM pages",
    "job_outcomes": "SELECT job_id, CASE WHEN reason IS NULL THEN 'ok' ELSE 'failed' END AS status, "
    "coalesce(reason, '') AS detail FROM outcome",
    "phase_report": _phase(),
    "sampling_interval": "SELECT job_id, node_id, " + _r(6, first_ts="first_ts", interval="est") + " FROM node",
    "rate_gate": "SELECT job_id, node_id, CAST(usable AS INTEGER) AS usable FROM node",
    "gpu_rollup": "SELECT job_id, node_id, k, " + _r(6, ts="ts", **_M) + " FROM roll",
    "job_t0": "SELECT job_id, " + _r(6, t0="t0") + " FROM gate",
    "node_ratio_gate": "SELECT job_id, used AS nodes_used, total AS nodes_total, coalesce(reason, '') AS reason FROM gate",
    "time_bins": "SELECT job_id, node_id, k, " + _r(4, **_M) + " FROM bins",
    "node_grid_ffill": "SELECT job_id, node_id, k, " + _r(4, **_M) + " FROM nfill WHERE k >= 0",
    "cross_node_agg": "SELECT job_id, k, " + _r(4, **_M) + " FROM crossed",
    "job_grid_fill": "SELECT job_id, k, " + _r(4, **_M) + " FROM jfill",
    "trace_projection": "SELECT job_id, k, "
    + _r(3, timestamp="k * 3600.0::DOUBLE", **{n: f"CAST({s} AS FLOAT)" for s, n in zip("umbw", CHANNEL_NAMES)})
    + " FROM crossed",
    "resampled_traces": _select(_T, "trace"),
    "jobs_joined": "SELECT job_id, cpus_req, mem_req, round(priority, 6) AS priority, state, job_type, "
    "time_start, file_path, nodes_req, duration_sec, length FROM ljoin",
    "cyclical_time": "SELECT job_id, "
    + _r(9, **{f"{a}_{b}": f"{a}_{b}" for a in ("hour", "dow", "dom") for b in ("sin", "cos")})
    + " FROM lfeat",
    "mem_sentinel": "SELECT job_id, mem_unlimited, mem_known FROM lin",
    "quantile_fit": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, i, n, round(q, 6) AS q FROM {t}_q"
        for c, t in (
            ("mem_known", "lmem"), ("cpus_log", "lcpus"), ("duration_log", "ldur"), ("priority_log", "lpri"),
        )
    ),
    "quantile_normal": _scaled("lnod", "z"),
    "mem_req_scaled": "SELECT j.job_id, round(coalesce(z.z, 0), 6) AS mem_req_scaled "
    "FROM lin j LEFT JOIN lmem_z z ON z.job_id = j.job_id",
    "cpus_req_scaled": _scaled("lcpus", "cpus_req_scaled"),
    "duration_scaled": _scaled("ldur", "duration_scaled"),
    "priority_scaled": _scaled("lpri", "priority_scaled"),
    "node_features": "SELECT job_id, nodes_req_is_one, round(CAST(nodes_req_log AS DOUBLE), 9) AS nodes_req_log FROM lfeat",
    "priority_tier": "SELECT job_id, tier FROM lfeat",
    "one_hot_tier": "SELECT job_id, ptier_0, ptier_1, ptier_2 FROM lfeat",
    "job_type_onehot": "SELECT job_id, type_batch, type_interactive, type_map, type_other FROM lfeat",
    "state_onehot": "SELECT job_id, state_other, state_3, state_4, state_5, state_6, state_11 FROM lfeat",
    "job_features": _select(_FEATURE_VIEW, "lfeat"),
    "feature_histograms": """
SELECT r.column_name, r.bin, round(r.lo + r.bin * ((r.hi - r.lo) / 100.0::DOUBLE), 6) AS left_edge, coalesce(c.n, 0) AS n
FROM (SELECT *, unnest(generate_series(0, 99)) AS bin FROM ranges) r
LEFT JOIN (SELECT x.column_name, least(CAST(floor((x.v - g.lo) / (g.hi - g.lo) * 100.0::DOUBLE) AS BIGINT), 99) AS bin,
                  count(*) AS n
           FROM cells x JOIN ranges g ON g.column_name = x.column_name GROUP BY 1, 2) c
  ON c.column_name = r.column_name AND c.bin = r.bin""",
    "feature_correlation": f"SELECT a AS col_a, b AS col_b, round(r, 6) AS r FROM ({_correlation()})",
    "required_columns": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, 1 AS present, count({c}) AS n_values FROM lfeat"
        for c in ("job_id", "file_path", "length", "duration_sec", *FEATURES)
    ),
    "finite_jobs": "SELECT job_id, length FROM lusable",
    "split_random": "SELECT job_id, split FROM lsplit",
    "split_stratified": "SELECT job_id, stratum, split FROM lstrat",
    "split_coverage": "SELECT count(DISTINCT stratum) AS n_total, "
    "count(DISTINCT stratum) FILTER (WHERE split = 'train') AS n_train, "
    "count(DISTINCT stratum) FILTER (WHERE split = 'test') AS n_test FROM lstrat",
    "stats_sample": "SELECT job_id FROM (SELECT job_id, count(*) OVER () AS n, "
    "row_number() OVER (ORDER BY md5(job_id || '|42'), job_id) AS rn FROM lusable) "
    "WHERE rn <= greatest(1, floor(n * 0.25::DOUBLE))",
    "norm_stats": "SELECT 'gpu_used_pct' AS channel, 'linear_pct' AS norm, 0.0::DOUBLE AS log_mean, 1.0::DOUBLE AS log_std "
    "UNION ALL SELECT 'memory_used_pct', 'linear_pct', 0.0, 1.0 "
    "UNION ALL SELECT 'memory_used_MiB', 'log1p_zscore', round(m2, 6), round(s2, 6) FROM stats "
    "UNION ALL SELECT 'power_draw_W', 'log1p_zscore', round(m3, 6), round(s3, 6) FROM stats",
    "normalized_traces": "SELECT job_id, k, " + _r(5, z0="z0", z1="z1", z2="z2", z3="z3") + " FROM norm",
    "chunk_index": "SELECT split, job_id, unnest(generate_series(0, greatest(1, (length + 8191) // 8192) - 1)) AS chunk_idx FROM lsplit",
    "chunk_reindex": "SELECT split, job_id, unnest(generate_series(0, greatest(1, (length + 47) // 48) - 1)) AS chunk_idx FROM ejobs",
    "window_context": "SELECT * FROM wctx",
    "window_future": "SELECT * EXCLUDE (mask, n_real) FROM wfut",
    "window_mask": "SELECT job_id, chunk_idx, mask FROM wfut",
    "window_cond": " UNION ALL ".join(
        f"SELECT job_id, {i} AS pos, round(CAST(CAST({c} AS FLOAT) AS DOUBLE), 5) AS v FROM ejobs"
        for i, c in enumerate(FEATURES)
    ),
    "training_windows": "SELECT c.*, f.* EXCLUDE (job_id, chunk_idx, mask), round("
    + " + ".join(f"CAST(CAST(j.{c} AS FLOAT) AS DOUBLE)" for c in FEATURES)
    + ", 4) AS cond_sum FROM wctx c JOIN wfut f ON f.job_id = c.job_id AND f.chunk_idx = c.chunk_idx "
    "JOIN ejobs j ON j.job_id = c.job_id AND j.split = 'train'",
    "epoch_plan": _epoch(2, 16, 3, "n"),
    "batch_layout": f"SELECT rank, step, count(*) AS n_samples FROM ({_epoch(3, 8, 0, '12')}) GROUP BY rank, step",
    "assembled_batches": f"""
SELECT e.rank, e.step, row_number() OVER (PARTITION BY e.rank, e.step ORDER BY e.i) - 1 AS pos, e.job_id, e.chunk_idx,
       md5(f.target) AS target_md5, c.ctx_3_md5
FROM ({_epoch(3, 8, 0, '12')}) e
JOIN wfut f ON f.job_id = e.job_id AND f.chunk_idx = e.chunk_idx
JOIN (SELECT job_id, chunk_idx, md5(ctx3) AS ctx_3_md5 FROM wctx) c
  ON c.job_id = e.job_id AND c.chunk_idx = e.chunk_idx""",
    "assembled_epoch": f"""
SELECT e.rank, e.step, row_number() OVER (PARTITION BY e.rank, e.step ORDER BY e.i) - 1 AS pos, e.job_id, e.chunk_idx,
       md5(f.target) AS target_md5, c.ctx_3_md5
FROM ({_epoch(3, 8, 0, "n")}) e
JOIN wfut f ON f.job_id = e.job_id AND f.chunk_idx = e.chunk_idx
JOIN (SELECT job_id, chunk_idx, md5(ctx3) AS ctx_3_md5 FROM wctx) c
  ON c.job_id = e.job_id AND c.chunk_idx = e.chunk_idx""",
    "epoch_files": f"""
SELECT e.rank, e.step, row_number() OVER (PARTITION BY e.rank, e.step ORDER BY e.i) - 1 AS pos, e.job_id, e.chunk_idx,
       count(*) OVER (PARTITION BY e.rank, e.step) AS n_samples, md5(f.target) AS target_md5, c.ctx_3_md5
FROM ({_epoch(2, 16, 1, "n")}) e
JOIN wfut f ON f.job_id = e.job_id AND f.chunk_idx = e.chunk_idx
JOIN (SELECT job_id, chunk_idx, md5(ctx3) AS ctx_3_md5 FROM wctx) c
  ON c.job_id = e.job_id AND c.chunk_idx = e.chunk_idx""",
    "windows_per_job": "SELECT job_id, length, by_duration, CAST(25 AS BIGINT) AS fixed, "
    "greatest(1, (length + 63) // 64) AS by_length FROM capped",
    "score_plan": "SELECT job_id, w, start, n_real FROM plan",
    "score_carry": _score_carry(),
    "score_linear": "SELECT job_id, k, round(gen_z, 5) AS gen_z FROM pairs",
    "stratified_subsample": f"""
SELECT job_id FROM (
  SELECT job_id, row_number() OVER (ORDER BY md5(job_id || '|42'), job_id) AS pick FROM (
    SELECT job_id, rn, (SELECT count(DISTINCT {_STRATUM}) FROM lusable) AS cells
    FROM (SELECT job_id, row_number() OVER (PARTITION BY {_STRATUM} ORDER BY md5(job_id || '|42'), job_id) AS rn
          FROM lusable))
  WHERE rn <= greatest(1, 100 // cells))
WHERE pick <= 100""",
    "denormalized_power": "SELECT job_id, k, " + _r(3, real_w="real_w", gen_w="gen_w") + " FROM watts",
    "trace_metrics": _select(_SUMMARY_VIEW, "summary"),
    "pearson_normalized": "SELECT job_id, round(pearson_r, 5) AS pearson_r FROM pearz",
    "attach_pearson": "SELECT z.job_id, round(CASE WHEN CAST(z.job_id AS BIGINT) % 2 = 0 "
    "THEN coalesce(s.pearson_r, z.pearson_r) ELSE z.pearson_r END, 5) AS pearson_r "
    "FROM pearz z JOIN summary s ON s.job_id = z.job_id",
    "eval_headline": "SELECT count(*) AS n_jobs, "
    + _r(
        5, pearson_r_mean="avg(pearson_r)", pearson_r_median="median(pearson_r)",
        share_above="avg(CASE WHEN pearson_r > 0.3 THEN 1.0 WHEN pearson_r IS NOT NULL THEN 0.0 END)",
        rmse_mean="avg(rmse)", rmse_median="median(rmse)", mae_mean="avg(mae)", mae_median="median(mae)",
    )
    + " FROM summary",
    "best_jobs": f"SELECT {_SUMMARY_VIEW} FROM (SELECT * FROM summary WHERE pearson_r IS NOT NULL "
    "ORDER BY pearson_r DESC, job_id LIMIT 6)",
    "worst_jobs": f"SELECT {_SUMMARY_VIEW} FROM (SELECT * FROM summary WHERE pearson_r IS NOT NULL "
    "ORDER BY pearson_r, job_id LIMIT 6)",
    "random_jobs": "SELECT job_id, round(pearson_r, 5) AS pearson_r FROM "
    "(SELECT * FROM summary ORDER BY md5(job_id || '|42'), job_id LIMIT 6)",
    "trace_export": "SELECT job_id, "
    + _r(3, timestamp_s="k * 3600::DOUBLE", real_power_W="real_w", synthetic_power_W="gen_w")
    + " FROM watts",
    "trace_captions": "SELECT w.job_id, max(CAST(j.nodes_req AS BIGINT)) AS nodes_req, "
    + _r(
        3, duration_min="count(*) * 3600::DOUBLE / 60", real_mean="avg(real_w)", real_max="max(real_w)",
        gen_mean="avg(gen_w)", gen_max="max(gen_w)",
    )
    + " FROM watts w JOIN ejobs j ON j.job_id = w.job_id GROUP BY w.job_id",
    "masked_window_loss": """
SELECT count(*) AS n_windows, count(*) FILTER (WHERE loss > 1) AS n_skipped,
       round(avg(CASE WHEN loss > 1 THEN 0 ELSE loss END), 6) AS loss
FROM (SELECT n.job_id, n.k // 64 AS chunk_idx, avg((l.intercept + l.slope * n.z0::DOUBLE - n.z3::DOUBLE) ** 2) AS loss
      FROM norm n JOIN ejobs j ON j.job_id = n.job_id AND j.split = 'test' CROSS JOIN line l GROUP BY 1, 2)""",
}
ORACLE = {name: compose(text) for name, text in _STATEMENTS.items()}
