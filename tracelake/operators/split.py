"""Job filtering and reproducible, exactly sized splits and samples.

Order within a sample is a seeded hash of the job id, so a choice can be repeated on
any engine and does not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.config import FEATURES
from tracelake.functions.expressions import half_even_count, is_finite, seeded_hash
from tracelake.operators.selection import mark_first

CHECKED = (*FEATURES, "length", "duration_sec")


def finite_condition(columns=CHECKED) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & is_finite(F.col(c))
    return ok


def usable_jobs(features: DataFrame, columns=CHECKED) -> DataFrame:
    """Jobs whose checked columns are all finite and whose length is positive."""
    return features.filter(finite_condition(columns) & (F.col("length") > 0))


def drop_counts(features: DataFrame, columns=CHECKED) -> DataFrame:
    """One row: jobs loaded, dropped as non-finite, dropped as empty, and kept."""
    finite = finite_condition(columns)
    positive = F.coalesce(F.col("length") > 0, F.lit(False))
    return features.agg(
        F.count(F.lit(1)).alias("loaded"),
        F.count_if(~finite).alias("dropped_non_finite"),
        F.count_if(finite & ~positive).alias("dropped_empty"),
        F.count_if(finite & positive).alias("kept"),
    )


def stratum_key(columns) -> Column:
    return F.concat_ws("_", *[F.col(c).cast("string") for c in columns])


def _label(marked: DataFrame) -> DataFrame:
    part = F.when(F.col("selected"), F.lit("test")).otherwise(F.lit("train"))
    return marked.withColumn("split", part).drop("selected")


def _first(jobs: DataFrame, wanted: Callable[[Column], Column], seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    return mark_first(jobs, seeded_hash(seed, F.col("job_id")), ("job_id",), wanted, by)


def random_split(jobs: DataFrame, frac: float, seed: int) -> DataFrame:
    """Add ``split``; the test part has exactly round-half-even(N * frac) jobs."""
    return _label(_first(jobs, lambda n: half_even_count(n, frac), seed))


def stratified_split(jobs: DataFrame, columns, frac: float, seed: int) -> DataFrame:
    """Add ``split``; each stratum gives at least one and at most all of its jobs to test."""
    keyed = jobs.withColumn("stratum", stratum_key(columns))
    one = F.lit(1).cast("long")
    return _label(_first(keyed, lambda n: F.least(n, F.greatest(one, half_even_count(n, frac))), seed, ("stratum",)))


def split_jobs(jobs: DataFrame, cfg) -> DataFrame:
    """Stratified when columns are configured, else random."""
    if cfg.stratify_cols:
        return stratified_split(jobs, cfg.stratify_cols, cfg.test_frac, cfg.seed).drop("stratum")
    return random_split(jobs, cfg.test_frac, cfg.seed)


def split_coverage(labelled: DataFrame) -> DataFrame:
    """Distinct strata overall, in train and in test, from a ``stratum``/``split`` table."""
    seen = labelled.groupBy("stratum").agg(
        F.max((F.col("split") == "train").cast("int")).alias("train"),
        F.max((F.col("split") == "test").cast("int")).alias("test"),
    )
    return seen.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col("train") == 1).alias("n_train"),
        F.count_if(F.col("test") == 1).alias("n_test"),
    )


def sample_jobs(jobs: DataFrame, frac: float | None, seed: int) -> DataFrame:
    """max(1, int(N * frac)) jobs, or all of them when no fraction is set."""
    if not frac or not 0.0 < frac < 1.0:
        return jobs
    one = F.lit(1).cast("long")
    taken = _first(jobs, lambda n: F.greatest(one, F.floor(n.cast("double") * F.lit(float(frac)))), seed)
    return taken.filter("selected").drop("selected")


def stratified_subsample(jobs: DataFrame, n: int, columns, seed: int) -> DataFrame:
    """At most ``n`` jobs, the same quota ``max(1, n div strata)`` from every stratum.

    A plain sample of ``min(n, N)`` when there are no strata or enough room. Small
    strata leave the result short of ``n``; too many strata are trimmed to ``n``.
    """
    if not columns:
        return _at_most(jobs, n, seed)
    keyed = jobs.withColumn("stratum", stratum_key(columns))
    strata = keyed.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    totals = strata.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_jobs"), F.count(F.lit(1)).alias("n_strata")).first()
    if n >= totals["n_jobs"]:
        return _at_most(jobs, n, seed)
    quota = F.lit(max(1, n // totals["n_strata"])).cast("long")
    taken = _first(keyed, lambda rows: F.least(rows, quota), seed, ("stratum",))
    return _at_most(taken.filter("selected").drop("selected", "stratum"), n, seed)


def _at_most(jobs: DataFrame, n: int, seed: int) -> DataFrame:
    taken = _first(jobs, lambda rows: F.least(rows, F.lit(n).cast("long")), seed)
    return taken.filter("selected").drop("selected")


def random_jobs(jobs: DataFrame, k: int, seed: int) -> DataFrame:
    """A small reproducible sample: planned as a top-k, not a sort."""
    return (
        jobs.withColumn("_h", seeded_hash(seed, F.col("job_id")))
        .orderBy("_h", "job_id")
        .limit(k)
        .drop("_h")
    )
