"""The stage tables of one run over the given tables.

Each stage is written once to the shared folder and read by the stages after it, as a
production run does between its steps. Nothing is kept on the driver but the path.
"""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import coverage, features, layout, normalize, scoring, split, windows
from tracelake.operators.resample import resample_traces
from tracelake.plans import bindings
from tracelake.storage import materialize


class EventRun:
    """Resample, features, split, normalization and scoring of the ``events`` jobs."""

    cfg = bindings.CONFIG

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def telemetry(self) -> DataFrame:
        return bindings.telemetry(self.spark, self.sf_dir)

    @cached_property
    def facts(self) -> DataFrame:
        return materialize(coverage.trace_facts(self.telemetry, self.cfg.resample), "facts")

    @cached_property
    def index(self) -> DataFrame:
        return coverage.trace_index(self.facts, self.cfg.resample)

    @cached_property
    def traces(self) -> DataFrame:
        """Traces of the indexed jobs; jobs outside the duration bounds are not resampled."""
        parts = layout.tasks_of(self.spark, coverage.grid_rows(self.index))
        cfg = replace(self.cfg.resample, grid_parts=parts)
        return materialize(resample_traces(self.telemetry, cfg, only_jobs=self.index), "traces")

    @cached_property
    def features(self) -> DataFrame:
        scheduler = features.select_scheduler(bindings.scheduler_raw(self.spark, self.sf_dir))
        joined = features.join_jobs(scheduler, features.select_index(self.index))
        return features.build_features(materialize(joined, "joined"), self.cfg.features)

    @cached_property
    def jobs(self) -> DataFrame:
        """Split job table with the measured length."""
        labelled = split.split_jobs(split.usable_jobs(self.features), self.cfg.split)
        return materialize(normalize.attach_lengths(labelled, self.traces), "jobs")

    def part(self, name: str) -> DataFrame:
        return self.jobs.filter(F.col("split") == name)

    @cached_property
    def stats_table(self) -> DataFrame:
        return materialize(
            normalize.fit_norm(self.traces, self.part("train"), self.cfg.norm), "norm-stats"
        )

    @cached_property
    def stats(self) -> normalize.ChannelStats:
        return normalize.ChannelStats.from_table(self.stats_table)

    @cached_property
    def norm(self) -> DataFrame:
        return normalize.normalize(self.traces, self.stats, self.cfg.norm)

    @cached_property
    def chunks(self) -> DataFrame:
        return windows.chunk_index(self.jobs, self.cfg.window.stride)

    @cached_property
    def line(self) -> tuple[float, float]:
        row = scoring.fit_linear(self.norm, self.part("train")).first()
        return row["slope"], row["intercept"]

    def capped(self, jobs: DataFrame) -> DataFrame:
        return scoring.windows_per_job(jobs, replace(self.cfg.window, max_windows=None))

    def score(self, jobs: DataFrame, predictor) -> DataFrame:
        plan = scoring.score_plan(self.capped(jobs), self.cfg.window.w_pred)
        scored = scoring.score_jobs(
            self.norm, plan, windows.conditioning(jobs), predictor, self.cfg.window
        )
        return scoring.unpack_scores(materialize(scored, "scored"))

    @cached_property
    def pairs(self) -> DataFrame:
        """Real and generated power of the test jobs under the linear predictor."""
        return self.score(self.part("test"), scoring.linear_predictor(*self.line))


class LargeRun:
    """The feature stages over the ``lineitem``/``orders`` jobs."""

    cfg = bindings.LARGE

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def index(self) -> DataFrame:
        bounds = self.cfg.resample
        raw = bindings.large_index_raw(self.spark, self.sf_dir)
        return raw.filter(F.col("duration_sec").between(bounds.lower_sec, bounds.upper_sec))

    @cached_property
    def joined(self) -> DataFrame:
        scheduler = features.select_scheduler(bindings.scheduler_raw(self.spark, self.sf_dir))
        return materialize(features.join_jobs(scheduler, features.select_index(self.index)), "joined")

    @cached_property
    def features(self) -> DataFrame:
        return materialize(features.build_features(self.joined, self.cfg.features), "features")

    @cached_property
    def jobs(self) -> DataFrame:
        return split.usable_jobs(self.features)


_RUNS: dict = {}


def run(kind: type, spark: SparkSession, sf_dir: str):
    """The run of this session over ``sf_dir``; its stages are built on first use."""
    key = (kind, spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        _RUNS[key] = kind(spark, sf_dir)
    return _RUNS[key]
