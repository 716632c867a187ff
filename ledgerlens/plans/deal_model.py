"""The FX lifecycle: what history holds, bounds and expected values fitted on it, and the verdict on new deals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fx as X
from ..operators.encoders import MinMax
from ..operators.skew import column_medians, spread_lookup
from ..operators.wide import CategoryProfile, WideEncoder
from ..storage import stage

CATEGORIES = ["FX_Instrument_Type", "BUnit", "Cpty", "PrimaryCurr", "BuyCurr", "SellCurr"]
GROUPED, PLAIN = ["FaceValue", "TDays"], ["BuyAmount", "SellAmount", "SpotRate"]


class DealModel:
    """Expected features of a counterparty's deals: medians of the scaled numbers, shares of the categories.

    A number deviates by its distance above the expected one, a category by 1 minus the share of its value; both lie
    between 0 and 1, as the numbers are scaled to their range in history.
    """

    def __init__(self, key: str = "Cpty", id_col: str = "UniqueId", high: float = 0.995, low: float = 0.95, many: int = 2):
        self.key, self.id_col, self.high, self.low, self.many = key, id_col, high, low, many

    def _scaled(self, deals: DataFrame) -> DataFrame:
        clipped = X.scale_deals(deals, self.face, self.tenor).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in GROUPED})
        return self.encoder.transform(stage(self.ranges.transform(clipped), "clipped"))

    def fit(self, deals: DataFrame) -> "DealModel":
        self.history = stage(deals, "history")
        self.face, self.tenor = (stage(b, "bounds") for b in X.fit_deal_bounds(self.history))
        self.ranges = MinMax(PLAIN).fit(self.history)
        self.encoder = WideEncoder(max_onehot=1_000_000).fit(self.history, CATEGORIES)
        scaled = stage(self._scaled(self.history), "scaled")
        self.medians = stage(column_medians(scaled, [self.key], GROUPED + PLAIN), "medians")
        self.shares = CategoryProfile(self.encoder, [self.key]).fit(scaled)
        return self

    def deviations(self, deals: DataFrame) -> DataFrame:
        """(id, feature, deviation) for every deal and feature; keys that history lacks are expected to be 0 everywhere."""
        rows = stage(self._scaled(deals), "scaled")
        expected = self.medians.select(self.key, *[F.col(c).alias(f"p_{c}") for c in GROUPED + PLAIN])
        met = spread_lookup(rows, expected, [self.key])
        numbers = met.select(self.id_col, F.inline(F.array(*[F.struct(
            F.lit(c).alias("feature"), (F.col(c) - F.coalesce(f"p_{c}", F.lit(0.0))).alias("deviation")) for c in GROUPED + PLAIN])))
        active = rows.select(self.id_col, self.key, F.posexplode("active").alias("g", "i")).filter("i >= 0")
        shared = spread_lookup(active, self.shares.shares, [self.key, "g", "i"], null_safe=True)
        names = F.get(F.array(*map(F.lit, CATEGORIES)), F.col("g"))
        groups = shared.select(self.id_col, names.alias("feature"), (1 - F.coalesce("p", F.lit(0.0))).alias("deviation"))
        return numbers.unionByName(groups)

    def score(self, deals: DataFrame) -> DataFrame:
        """Anomaly, Reason, rmse and deviated (features by falling deviation) for every deal.

        Unseen entities and currencies come first; else a deal is unusual if one feature deviates by more than ``high``
        or more than ``many`` by more than ``low``, the unit and the counterparty aside.
        """
        deals = stage(deals, "deals")
        rows = stage(self.deviations(deals), "deviations")
        used = ~F.col("feature").isin("BUnit", "Cpty")
        entry = F.when(used & (F.col("deviation") > self.low), F.struct((-F.col("deviation")).alias("d"), F.col("feature").alias("f")))
        found = rows.groupBy(self.id_col).agg(
            F.sqrt(F.avg(F.col("deviation") * F.col("deviation"))).alias("rmse"), F.sort_array(F.collect_list(entry)).alias("e"))
        above = F.filter("e", lambda x: -x["d"] > self.high)
        chosen = F.when(F.size(above) > 0, above).when(F.size("e") > self.many, F.col("e")).otherwise(F.filter("e", lambda x: F.lit(False)))
        found = found.select(self.id_col, "rmse", F.transform(chosen, lambda x: x["f"]).alias("deviated"))
        judged = spread_lookup(X.check_deals(deals, self.history), found, [self.id_col])
        unusual = (F.col("Anomaly") == "No") & (F.size("deviated") > 0)
        text = F.concat(F.lit("This FX deal deviates from the usual deals of "), F.col(self.key), F.lit(" in: "), F.array_join("deviated", ", "))
        return judged.withColumns({"Reason": F.when(unusual, text).otherwise(F.col("Reason")),
                                   "Anomaly": F.when(unusual, "Yes").otherwise(F.col("Anomaly"))})
