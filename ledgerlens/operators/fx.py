"""FX deals: features, grouped scaling, unseen entities and currencies, and the deviation rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..storage import stage
from .cleaning import dedupe_rows, nonzero_deals
from .encoders import clip_counts, fit_group_bounds, minmax_by_group
from .skew import lookup, spread_lookup

PAIR = ["BUnit", "Cpty"]
GROUP = ["BUnit", "Cpty", "PrimaryCurr"]
KIND = ["FX_Instrument_Type"]
COLUMNS = ["FX_Instrument_Type", "BUnit", "Cpty", "DealDate", "MaturityDate", "PrimaryCurr", "BuyAmount", "SellAmount",
           "BuyCurr", "SellCurr", "SpotRate", "ForwardPoints"]


def fx_features(df: DataFrame) -> DataFrame:
    """Weekend flag, tenor and face value."""
    c = F.col
    return df.withColumns({
        "Is_weekend_date": (F.weekday("DealDate") >= 5).cast("int"),
        "TDays": X.tenor_days(c("DealDate"), c("MaturityDate")).cast("double"),
        "FaceValue": X.face_value(c("PrimaryCurr"), c("BuyCurr"), c("SellCurr"), c("BuyAmount"), c("SellAmount")),
    })


def training_deals(df: DataFrame) -> DataFrame:
    """Deals with both amounts, without repeats, with features."""
    return fx_features(dedupe_rows(nonzero_deals(df), [c for c in COLUMNS if c in df.columns]))


def fit_deal_bounds(deals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clip bounds of the face value per (BUnit, Cpty, PrimaryCurr) and of the tenor per instrument."""
    return (stage(fit_group_bounds(deals, GROUP, "FaceValue"), "face-bounds"),
            stage(fit_group_bounds(deals, KIND, "TDays"), "tenor-bounds"))


def scale_deals(deals: DataFrame, face: DataFrame, tenor: DataFrame) -> DataFrame:
    return minmax_by_group(minmax_by_group(deals, GROUP, "FaceValue", face), KIND, "TDays", tenor)


def deal_clip_counts(deals: DataFrame, face: DataFrame, tenor: DataFrame) -> DataFrame:
    """(column, outside, below, above) for both scaled columns."""
    parts = [clip_counts(deals, keys, col, b).select(F.lit(col).alias("column"), "*")
             for keys, col, b in ((GROUP, "FaceValue", face), (KIND, "TDays", tenor))]
    return parts[0].unionByName(parts[1])


def range_flags(deals: DataFrame, face: DataFrame, tenor: DataFrame) -> DataFrame:
    """Replace face value and tenor by 0 inside and 1 outside the learned range of their group."""
    out = deals
    for keys, col, b in ((GROUP, "FaceValue", face), (KIND, "TDays", tenor)):
        out = spread_lookup(out, b.select(*keys, F.col("lower").alias("__a"), F.col("upper").alias("__b")), keys)
        out = out.withColumn(col, X.range_flag(F.col(col), F.col("__a"), F.col("__b"))).drop("__a", "__b")
    return out


def currency_sets(history: DataFrame) -> DataFrame:
    """Distinct (Cpty, side, currency) of the history."""
    sides = F.array(F.struct(F.lit("buy").alias("side"), F.col("BuyCurr").alias("currency")),
                    F.struct(F.lit("sell").alias("side"), F.col("SellCurr").alias("currency")))
    return history.select("Cpty", F.inline(sides)).distinct()


def currency_lists(sets: DataFrame) -> DataFrame:
    """Buy and sell currencies per counterparty for display (as many as there are currencies)."""
    return sets.groupBy("Cpty").agg(*[
        F.array_sort(F.collect_set(F.when(F.col("side") == s, F.col("currency")))).alias(s) for s in ("buy", "sell")])


def _known(combos: DataFrame, table: DataFrame, cols: list[str], flag: str) -> DataFrame:
    return lookup(combos, table.select(*cols).distinct().withColumn(flag, F.lit(1)), cols)


def _engaged(subject: Column) -> Column:
    return F.concat(F.lit("This deal appears anomalous because the "), subject,
                    F.lit(" has not previously engaged in any FX contracts."))


def _entity_flags(combos: DataFrame, history: DataFrame) -> DataFrame:
    out = combos
    for c in GROUP:
        out = _known(out, history, [c], f"__k_{c}")
    bu, cp, pc = (F.col(f"__k_{c}").isNull() for c in GROUP)
    names = {"BUnit": "BusinessUnit", "Cpty": "CounterParty", "PrimaryCurr": "PrimaryCurrency"}

    def text(*cols: str) -> Column:
        label = ", ".join(names[c] for c in cols)
        if len(cols) == 1:
            return _engaged(F.concat(F.lit(f"{label} "), F.col(cols[0])))
        quoted = F.concat_ws(", ", *[F.concat(F.lit("'"), F.col(c), F.lit("'")) for c in cols])
        return _engaged(F.concat(F.lit(f"{label} ("), quoted, F.lit(")")))

    message = (
        F.when(bu & cp & pc, text(*GROUP)).when(bu & cp, text("BUnit", "Cpty")).when(cp & pc, text("Cpty", "PrimaryCurr"))
        .when(bu & pc, text("BUnit", "PrimaryCurr")).when(bu, text("BUnit")).when(cp, text("Cpty"))
        .when(pc, text("PrimaryCurr")).otherwise(""))
    return out.select(*combos.columns, (bu | cp | pc).cast("int").alias("is_unseen_entity"), message.alias("entity_reason"))


def _currency_flags(combos: DataFrame, sets: DataFrame) -> DataFrame:
    out = _known(combos, sets, ["Cpty"], "__cp")
    for side, col in (("buy", "BuyCurr"), ("sell", "SellCurr")):
        used = sets.filter(F.col("side") == side).select("Cpty", F.col("currency").alias(col))
        out = _known(out, used, ["Cpty", col], f"__{side}")
    new, no_buy, no_sell = (F.col(c).isNull() for c in ("__cp", "__buy", "__sell"))
    cp = F.concat(F.lit("CounterParty "), F.col("Cpty"))
    buy, sell = (F.concat(F.lit(f"{n} "), F.col(c)) for n, c in (("BuyCurrency", "BuyCurr"), ("SellCurrency", "SellCurr")))
    message = (
        F.when(new, _engaged(cp)).when(no_buy & no_sell, _engaged(F.concat(cp, F.lit(" with "), sell, F.lit(" and "), buy)))
        .when(no_buy, _engaged(F.concat(cp, F.lit(" with "), buy)))
        .when(no_sell, _engaged(F.concat(cp, F.lit(" with "), sell))).otherwise(""))
    return out.select(*combos.columns, (new | no_buy | no_sell).cast("int").alias("is_unseen_currency"),
                      message.alias("currency_reason"))


def _by_combo(df: DataFrame, cols: list[str], flags) -> DataFrame:
    """Judge each distinct combination once and hand the verdict to its rows; many deals share one combination."""
    return spread_lookup(df, flags(df.select(*cols).distinct()), cols)


def flag_unseen_entities(df: DataFrame, history: DataFrame) -> DataFrame:
    """Business unit, counterparty or primary currency that history does not hold; all, pairs, then singles."""
    return _by_combo(df, GROUP, lambda combos: _entity_flags(combos, history))


def flag_unseen_currency(df: DataFrame, sets: DataFrame) -> DataFrame:
    """New counterparty, or a buy or sell currency it has not used."""
    return _by_combo(df, ["Cpty", "BuyCurr", "SellCurr"], lambda combos: _currency_flags(combos, sets))


def flag_deviations(df: DataFrame, cols: list[str], hi: float = 0.995, lo: float = 0.95, n: int = 2) -> DataFrame:
    """Anomaly if any deviation is above ``hi`` or more than ``n`` are above ``lo``; adds the deviating columns.

    Columns of the business unit and the counterparty are left out.
    """
    used = [c for c in cols if not c.startswith(("BUnit", "Cpty"))]
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("deviation")) for c in used])

    def above(limit: float) -> Column:
        return F.filter(entries, lambda e: e["deviation"] > limit)

    hit = df.withColumns({"__h": above(hi), "__l": above(lo)})
    chosen = F.when(F.size("__h") > 0, F.col("__h")).when(F.size("__l") > n, F.col("__l")).otherwise(F.filter(entries, lambda e: F.lit(False)))
    return hit.withColumn("deviated_features", chosen).withColumn(
        "is_anomaly", (F.size("deviated_features") > 0).cast("int")).drop("__h", "__l")


def check_deals(df: DataFrame, history: DataFrame) -> DataFrame:
    """Verdict per deal from the entity rule first and the currency rule second."""
    sets = currency_sets(history)

    def verdict(combos: DataFrame) -> DataFrame:
        flagged = _currency_flags(_entity_flags(combos, history), sets)
        reason = F.when(F.col("is_unseen_entity") == 1, F.col("entity_reason")).when(
            F.col("is_unseen_currency") == 1, F.col("currency_reason")).otherwise("This FX deal looks normal.")
        found = (F.col("is_unseen_entity") == 1) | (F.col("is_unseen_currency") == 1)
        return flagged.select(*combos.columns, F.when(found, "Yes").otherwise("No").alias("Anomaly"), reason.alias("Reason"))

    return _by_combo(df, [*GROUP, "BuyCurr", "SellCurr"], verdict)
