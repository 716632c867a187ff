"""The account-day lifecycle: detectors and their thresholds, flags with types, consensus, and the files for the analyst."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import account_day as A
from ..operators.skew import lookup, percentiles
from ..sources.io import read_table, write_table
from ..storage import stage


class DayReport:
    """Detectors fitted on the older account days, and the type baselines of their accounts."""

    def __init__(self, detectors: list, percentile: float = 0.975, min_account_rows: int = 30, z_flag: float = 3.0,
                 prepare: Callable[[DataFrame], DataFrame] = lambda df: df, row_id: str = "row_id"):
        self.detectors, self.percentile, self.prepare, self.row_id = detectors, percentile, prepare, row_id
        self.min_account_rows, self.z_flag = min_account_rows, z_flag

    def fit(self, train: DataFrame) -> "DayReport":
        """Each detector, with the percentile of its scores of the training days as threshold."""
        rows, cuts = stage(self.prepare(train), "train"), None
        self.models = {d.name: d.fit(rows) for d in self.detectors}
        for name, model in self.models.items():
            cut = percentiles(model.score(rows), [], "score", {"threshold": self.percentile})
            cut = cut.select(F.lit(name).alias("model"), "threshold")
            cuts = cut if cuts is None else cuts.unionByName(cut)
        self.cuts = stage(cuts, "thresholds")
        self.types = A.TypeAttributor.fit(train, self.min_account_rows, self.z_flag)
        return self

    def scores(self, days: DataFrame) -> DataFrame:
        """(model, row_id, score, threshold, is_anomaly) for every model and day."""
        rows, long = stage(self.prepare(days), "days"), None
        for name, model in self.models.items():
            part = model.score(rows).select(F.lit(name).alias("model"), F.col(self.row_id).alias("row_id"), "score")
            long = part if long is None else long.unionByName(part)
        met = lookup(long, self.cuts, ["model"], hint=True)  # a row for each detector
        return met.withColumn("is_anomaly", (F.col("score") > F.col("threshold")).cast("int"))

    def flags(self, days: DataFrame, long: DataFrame) -> DataFrame:
        """The flagged rows of the long table with type, feature, deviation and scope; a day is labelled once."""
        hit = long.filter("is_anomaly = 1")
        mine = lookup(days.withColumnRenamed(self.row_id, "row_id"), hit.select("row_id").distinct(), ["row_id"], how="left_semi")
        labels = self.types.label(mine).select("row_id", "anomaly_type", "top_feature", "top_z", "baseline_scope")
        return lookup(hit, labels, ["row_id"])

    def write(self, days: DataFrame, folder: str, report_types: tuple[str, ...] = ()) -> dict[str, str]:
        """Write all scores, the flagged rows by model and type, and the analyst's table; paths by name.

        The analyst's table has one row for each day that any model flagged (of the wanted types), with its features,
        verdicts and scores, the strongest agreement first; without such days it has its header only.
        """
        long = stage(self.scores(days), "scores")
        flags = stage(self.flags(days, long), "flags")
        agreed = A.consensus(flags, list(self.models), report_types)
        review = A.analyst_review(days, agreed, self.row_id)
        counts = A.type_counts(flags).select("model", "flagged", F.to_json("by_type").alias("by_type"))
        paths = {}
        for name, table in (("all_scores", long), ("by_type", counts), ("analyst_review", review)):
            paths[name] = f"{folder.rstrip('/')}/{name}.csv"
            write_table(table, paths[name], "csv")
        return paths


def read_review(spark, path: str) -> DataFrame:
    return read_table(spark, path, "csv")
