"""A target that audits what is written to it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.operators import statistics
from millrace.operators.quality import field_statistics
from millrace.sources.base import Target


class StreamAuditor(Target):
    """Keeps ``field_statistics``: a dict of each field's statistics.

    On the way to another ``target`` the audit is made by the job that writes it, without a scan of its own, from sketches where
    fields have many values; its ``state`` can be united with those of other tables.
    """

    def __init__(self, distinct_threshold: int | None = 10, target: Target | None = None):
        self.distinct_threshold, self.target, self.field_statistics = distinct_threshold, target, {}
        self.state: DataFrame | None = None

    def write(self, df: DataFrame) -> None:
        if self.target is None:
            found = field_statistics(df, self.distinct_threshold)
        else:
            observed = statistics.Observed(df)
            self.target.write(observed.df)
            self.state = observed.state()
            found = statistics.finish(self.state, self.distinct_threshold)
        self.field_statistics = {r["field"]: r.asDict() for r in found.collect()}
