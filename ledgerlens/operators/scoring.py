"""Reconstruction errors, gates, top deviations and the per-combination profile model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import scalars as X
from ..storage import stage
from .baselines import attach
from .skew import column_medians, percentiles, spread_lookup, with_scalars


def fit_profile(df: DataFrame, features: list[str], keys: list[str] = S.KEYS, approx: bool = False,
                stored: bool = False) -> DataFrame:
    """Expected value per key and feature: the training median, as columns ``p_<feature>``, one row per key."""
    if approx:
        sketches = [F.percentile_approx(F.col(c).cast("double"), 0.5, F.lit(10000)) for c in features]
        return df.groupBy(*keys).agg(*[m.alias(f"p_{c}") for m, c in zip(sketches, features)])
    rows = df.select(*keys, *features)
    medians = column_medians(rows if stored else stage(rows, "features"), keys, features)
    return medians.select(*keys, *[F.col(c).alias(f"p_{c}") for c in features])


def fit_profiles(df: DataFrame, features: list[str], keys: list[str] = S.KEYS, approx: bool = False
                 ) -> tuple[DataFrame, DataFrame]:
    """Profile per key and overall of stored rows."""
    return fit_profile(df, features, keys, approx, stored=True), fit_profile(df, features, [], approx, stored=True)


def apply_profile(df: DataFrame, profile: DataFrame, overall: DataFrame, features: list[str],
                  keys: list[str] = S.KEYS, stored: bool = False) -> DataFrame:
    """Add the expected value of every feature, the overall one for keys without a profile."""
    joined = with_scalars(attach(df, profile, keys, stored), overall)
    expected = {f"p_{c}": F.coalesce(f"p_{c}", f"__g.p_{c}") for c in features}
    return joined.withColumns(expected).drop("__g")


def recon_error(features: list[str], weights: dict[str, float] | None = None, pred: str = "p_{}",
                root: bool = False) -> Column:
    """(Weighted) mean squared difference over the features, or its root."""
    weights = weights or {}
    parts = [F.pow(F.col(c) - F.col(pred.format(c)), 2) * F.lit(float(weights.get(c, 1.0))) for c in features]
    mse = sum(parts[1:], parts[0]) / F.lit(float(len(parts)))
    return F.sqrt(mse) if root else mse


def fit_category_frequency(df: DataFrame, context: list[str], category: str) -> DataFrame:
    """Share of each category within its context."""
    counts = df.groupBy(*context, category).agg(F.count(F.lit(1)).alias("c"))
    totals = counts.groupBy(*context).agg(F.sum("c").alias("t"))
    joined = spread_lookup(counts, totals, context)
    return joined.select(*context, category, (F.col("c") / F.col("t")).alias("freq"))


def category_error(df: DataFrame, tables: dict[str, DataFrame], context: list[str], out: str = "category_error"
                   ) -> DataFrame:
    """Mean cross-entropy of the observed categories under their context's frequencies."""
    joined, parts = df, []
    for category, table in tables.items():
        joined = spread_lookup(joined, table.withColumnRenamed("freq", f"__f_{category}"), [*context, category])
        parts.append(-F.log(F.coalesce(f"__f_{category}", F.lit(0.0)) + 1e-8))
    return joined.withColumn(out, sum(parts[1:], parts[0]) / float(len(parts))).select(*df.columns, out)


def tolerance_gate(actual: Column, pred: Column, mad: Column, abs_tol: float = 1.0, mad_mult: float = 0.8,
                   pct_tol: float = 0.05) -> Column:
    """Difference at least as large as the absolute, spread-based and relative tolerance."""
    limit = F.greatest(F.lit(float(abs_tol)), mad_mult * mad, pct_tol * F.abs(actual))
    return F.abs(pred - actual) >= limit


def resolve_amount_columns(columns: list[str]) -> tuple[str, str, str]:
    """Names of the 30-day mean, deviation and z-score, preferring the per-combination ones."""
    base = ("mean_amount_30d", "std_amount_30d", "zscore_amount_30d")
    for suffix in ("_by_combo", "_combo", "_acct_bu_code"):
        names = tuple(b + suffix for b in base)
        if all(n in columns for n in names):
            return names
    return base


def adaptive_gate(df: DataFrame, actual: str = "amount", pred: str = "amount_pred", pred_log: str | None = None,
                  abs_diff: float = 1.0, std_mult: float = 0.5, pct: float = 0.05, tiny: float = 100.0,
                  log_tol: float = 0.25, z_min: float = 2.5) -> DataFrame:
    """Add the difference columns and ``passes_gate``: large in money (or in logs for tiny amounts) and unusual in z."""
    _, std_col, z_col = resolve_amount_columns(df.columns)
    a, small = F.col(actual), F.abs(F.col(actual)) <= tiny
    p = F.col(pred) if pred_log is None else F.when(small, X.inv_signed_log1p(F.col(pred_log))).otherwise(F.col(pred))
    out = df.withColumn(pred, p)
    gap, share = X.difference(F.col(pred), a)
    out = out.withColumns({"amount_diff_abs": gap, "amount_diff_pct": share})
    std = F.coalesce(F.col(std_col), F.lit(0.0)) if std_col in df.columns else F.lit(0.0)
    money = (F.col("amount_diff_abs") >= F.greatest(F.lit(abs_diff), std_mult * std)) | (F.col("amount_diff_pct") >= pct)
    logs = F.abs(X.signed_log1p(F.col(pred)) - X.signed_log1p(a)) >= log_tol
    size = F.when(small, logs).otherwise(money)
    unusual = F.abs(F.col(z_col)) >= z_min if z_min > 0 and z_col in df.columns else F.lit(True)
    return out.withColumn("passes_gate", F.coalesce(size & unusual, F.lit(False)))


def top_feature_deviations(df: DataFrame, features: list[str], weights: dict[str, float] | None = None, k: int = 2,
                           skip: tuple[str, ...] = ("y_norm",), pred: str = "p_{}") -> DataFrame:
    """Add name, actual and expected value of the k features with the largest weighted error, within the row.

    Equal errors are ordered by the later feature, as a reversed ascending sort does.
    """
    weights = weights or {}
    kept = [c for c in features if c not in skip]
    entries = F.array(*[
        F.struct((F.pow(F.col(c) - F.col(pred.format(c)), 2) * F.lit(float(weights.get(c, 1.0)))).alias("err"),
                 F.lit(i).alias("i"), F.lit(c).alias("name"), F.col(c).cast("double").alias("actual"),
                 F.col(pred.format(c)).alias("recon")) for i, c in enumerate(kept)])
    out = df.withColumn("__top", F.sort_array(entries, asc=False))
    for j in range(k):
        entry = F.get("__top", j)
        out = out.withColumns({f"top_feat{j + 1}_name": entry["name"], f"top_feat{j + 1}_actual": entry["actual"],
                               f"top_feat{j + 1}_recon": entry["recon"]})
    return out.drop("__top")


def group_errors(groups: dict[str, list[str]], pred: str = "p_{}") -> Column:
    """Array of (err, i, name): squared error summed over the columns of each group."""
    entries = []
    for i, (name, cols) in enumerate(groups.items()):
        parts = [F.pow(F.col(c) - F.col(pred.format(c)), 2) for c in cols]
        entries.append(F.struct(sum(parts[1:], parts[0]).alias("err"), F.lit(-i).alias("i"), F.lit(name).alias("name")))
    return F.array(*entries)


def group_contributions(df: DataFrame, groups: dict[str, list[str]], k: int = 3, pred: str = "p_{}",
                        out: str = "top_groups") -> DataFrame:
    """Add the k groups with the largest error, largest first (k=1 gives the single top contributor)."""
    return df.withColumn(out, F.slice(F.sort_array(group_errors(groups, pred), asc=False), 1, k))


def decode_category(columns: dict[str, str]) -> Column:
    """Label whose predicted column is largest; the first one on a tie."""
    entries = F.array(*[F.struct(F.col(c).cast("double").alias("v"), F.lit(-i).alias("i"), F.lit(label).alias("label"))
                        for i, (label, c) in enumerate(columns.items())])
    return F.array_max(entries)["label"]


def top_n(df: DataFrame, score: str, n: int, keys: list[str] | None = None, tie: tuple[str, ...] = ()) -> DataFrame:
    """The n largest scores, overall or per key (each task keeps at most n rows per key before the shuffle)."""
    order = [F.desc(score), *[F.asc(t) for t in tie]]
    if not keys:
        return df.orderBy(*order).limit(n)
    ranked = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("__rn") <= n).drop("__rn")


FOCUS_ALIASES = {"amount": "y_norm", "amount_norm": "y_norm", "amount_behavior": "y_norm"}


def feature_contributions(df: DataFrame, features: list[str], ids: list[str], weights: dict[str, float] | None = None,
                          focus: list[str] | None = None, top: int = 6, pred: str = "p_{}") -> DataFrame:
    """Long table per row and feature: values, difference, squared error, weight and contribution.

    Only the focus features, or each row's ``top`` largest contributions; ``rank`` orders them.
    """
    weights = weights or {}
    wanted = [FOCUS_ALIASES.get(f, f) for f in focus or []]
    wanted = [f for f in dict.fromkeys(wanted) if f in features]
    entries = []
    for i, c in enumerate(features):
        gap = F.col(pred.format(c)) - F.col(c)
        se, w = F.pow(gap, 2), F.lit(float(weights.get(c, 1.0)))
        entries.append(F.struct((se * w).alias("contribution"), F.lit(-i).alias("i"), F.lit(c).alias("feature"),
                                F.col(c).cast("double").alias("x_true"), F.col(pred.format(c)).alias("x_pred"),
                                gap.alias("diff"), se.alias("squared_error"), w.alias("weight")))
    ordered = F.sort_array(F.array(*entries), asc=False)
    ordered = F.filter(ordered, lambda e: e["feature"].isin(wanted)) if wanted else F.slice(ordered, 1, top)
    long = df.select(*ids, F.posexplode(ordered).alias("rank", "e"))
    return long.select(*ids, (F.col("rank") + 1).alias("rank"), F.col("e.feature"), F.col("e.x_true"), F.col("e.x_pred"),
                       F.col("e.diff"), F.col("e.squared_error"), F.col("e.weight"), F.col("e.contribution"))


def long_scores(df: DataFrame, scores: dict[str, str], thresholds: DataFrame, row_id: str) -> DataFrame:
    """(model, row_id, score, threshold, is_anomaly) from one score column per model and a (model, threshold) table."""
    models = list(scores)
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("score")) for m, c in scores.items()])
    cut = thresholds.groupBy().pivot("model", models).agg(F.first("threshold"))
    long = with_scalars(df.select(F.col(row_id).alias("row_id"), F.inline(rows)), cut, "__t")
    chosen = F.lit(None).cast("double")
    for m in models:
        chosen = F.when(F.col("model") == m, F.col(f"__t.{m}")).otherwise(chosen)
    out = long.withColumn("threshold", chosen).drop("__t")
    return out.withColumn("is_anomaly", (F.col("score") > F.col("threshold")).cast("int"))


def fit_score_thresholds(df: DataFrame, scores: dict[str, str], p: float = 0.975) -> DataFrame:
    """(model, threshold) from the training scores of several models, in one ordering."""
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("score")) for m, c in scores.items()])
    return percentiles(df.select(F.inline(rows)), ["model"], "score", {"threshold": p}).select("model", "threshold")
