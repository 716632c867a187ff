"""Thresholds on a score: percentiles, five simple rules, elbows and the tail summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from .baselines import lookup_with_global
from .skew import lookup, ordered_values, percentiles, with_scalars
from .sliding import window_medians


def fit_threshold(df: DataFrame, err: str, p: float = 0.99, keys: list[str] | None = None, min_rows: int = 20,
                  approx: bool = False, stored: bool = False) -> DataFrame:
    """Percentile of the score: one row, or one row per key with at least ``min_rows`` rows."""
    if not keys:
        return percentiles(df, [], err, {"threshold": p}, approx, stored=stored).select("threshold")
    found = percentiles(df, keys, err, {"threshold": p}, approx, stored=stored)
    return found.filter(F.col("n") >= min_rows).select(*keys, "threshold")


def apply_threshold(df: DataFrame, table: DataFrame, fallback: DataFrame, keys: list[str], out: str = "thr_recon",
                    stored: bool = False) -> DataFrame:
    """Threshold of the row's key, else the global one."""
    return lookup_with_global(df, table, fallback, keys, "threshold", out, stored)


def counted_scores(df: DataFrame, score: str) -> DataFrame:
    """Distinct scores with their number of rows, stored because every threshold reads them."""
    valid = df.filter(F.col(score).isNotNull())
    return stage(valid.groupBy(F.col(score).cast("double").alias("score")).agg(F.count(F.lit(1)).alias("c")), "scores")


def five_thresholds(df: DataFrame, score: str, contamination: float = 0.01) -> DataFrame:
    """(method, threshold, n_flagged, pct): IQR, sigma, modified z, percentile, value after the largest gap."""
    scores = counted_scores(df, score)
    q = stage(percentiles(scores, [], "score", {"q1": 0.25, "med": 0.5, "q3": 0.75, "top": 1 - contamination}, weight="c"),
              "quartiles")
    gaps = with_scalars(scores, q).withColumn("gap", F.abs(F.col("score") - F.col("__g.med"))).drop("__g")
    mad = percentiles(gaps, [], "gap", {"mad": 0.5}, weight="c").select("mad")
    ranked = ordered_values(scores, [], "score", weight="c")
    jump = ranked.filter("prev is not null").agg(
        F.max(F.struct((F.col("score") - F.col("prev")).alias("gap"), (-F.col("score")).alias("at"))).alias("j"))
    total = F.sum("c")
    mean = F.sum(F.col("score") * F.col("c")) / total
    moments = scores.agg(mean.alias("mean"), total.alias("n"))
    spread = with_scalars(scores, moments).agg(
        F.sqrt(F.sum(F.col("c") * F.pow(F.col("score") - F.col("__g.mean"), 2)) / F.sum("c")).alias("std"))
    one = moments.withColumns({
        "std": spread.scalar(), "q": q.select(F.struct("q1", "med", "q3", "top")).scalar(), "mad": mad.scalar(),
        "after_gap": jump.select(-F.col("j.at")).scalar(),
    })
    one = stage(one.select("*", "q.*").drop("q"), "thresholds")
    g = with_scalars(scores, one)
    limits = {
        "iqr": F.col("__g.q3") + 1.5 * (F.col("__g.q3") - F.col("__g.q1")),
        "zscore": F.col("__g.mean") + 3 * F.col("__g.std"),
        "modified_z": F.col("__g.med") + 3.5 * (F.col("__g.mad") / 0.6745),
        "percentile": F.col("__g.top"),
        "elbow": F.col("__g.after_gap"),
    }
    over = {m: F.col("score") > t for m, t in limits.items()}
    over["modified_z"] = 0.6745 * (F.col("score") - F.col("__g.med")) / (F.col("__g.mad") + 1e-8) > 3.5
    flat = g.agg(*[F.sum(F.when(f, F.col("c")).otherwise(0)).alias(m) for m, f in over.items()])
    limits_row = with_scalars(one, one).select(*[t.alias(f"t_{m}") for m, t in limits.items()], "n")
    both = with_scalars(limits_row, flat, "f")
    rows = F.array(*[
        F.struct(F.lit(m).alias("method"), F.col(f"t_{m}").alias("threshold"), F.col(f"f.{m}").alias("n_flagged"),
                 (F.col(f"f.{m}") * 100.0 / F.col("n")).alias("pct")) for m in limits])
    return both.select(F.inline(rows))


def choose_threshold(table: DataFrame, method: str) -> DataFrame:
    return table.filter(F.col("method") == method).select("threshold")


def _at_rank(ranked: DataFrame, rank) -> DataFrame:
    """Value at a 0-based rank given as an expression of ``total``."""
    hit = (F.col("below") <= rank) & (rank < F.col("below") + F.col("n"))
    return ranked.filter(hit).select("score")


def elbow_threshold(df: DataFrame, score: str, method: str = "slope", slope_frac: float = 0.20,
                    baseline_perc: float = 0.10, max_fraction: float = 0.05, drop_ratio: float = 0.20,
                    window_frac: float = 0.02, safety_margin: float = 0.02) -> DataFrame:
    """One row (threshold, n_flagged, n): where the sorted scores bend.

    ``slope``: before the first gap that is clearly steeper than the flat start (flags above it). ``tail``: the first
    score from the top that is followed by a small relative drop (flags it too). ``rolling``: before the first gap
    that is large against the median of the gaps before it (flags above it).
    """
    scores = counted_scores(df, score)
    ranked = ordered_values(scores, [], "score", weight="c")
    total = F.col("total")
    if method == "slope":
        start_n = F.greatest(F.lit(1).cast("long"), F.floor((total - 1) * baseline_perc))
        start = _at_rank(ranked, start_n).scalar()
        low = scores.agg(F.min("score")).scalar()
        steps = ranked.withColumns({"start_n": start_n, "limit": (1.0 + slope_frac) * (start - low) / start_n,
                                    "gap": F.col("score") - F.col("prev"), "i": F.col("below") - 1})
        steps = steps.filter("prev is not null")
        steep = (F.col("i") >= F.col("start_n")) & (F.col("gap") > F.col("limit"))
        found = steps.agg(
            F.min_by(F.when(steep, F.col("prev")), F.when(steep, F.col("i"))).alias("first"),
            F.max(F.struct("gap", (-F.col("i")).alias("i"), "prev")).alias("largest"))
        cut = found.select(F.coalesce("first", "largest.prev", low).alias("threshold"))
        keep = F.col("score") > F.col("__g.threshold")
    elif method == "tail":
        small = (F.col("n") > 1) & (F.col("score") != 0) | (
            F.try_divide(F.col("score") - F.col("prev"), F.col("score")) < drop_ratio)
        default = _at_rank(ranked, total - F.ceil(max_fraction * total)).scalar()
        cut = ranked.agg(F.max(F.when(small, F.col("score"))).alias("t")).select(
            F.coalesce(F.col("t"), default).alias("threshold"))
        keep = F.col("score") >= F.col("__g.threshold")
    elif method == "rolling":
        cut = _rolling_elbow(ranked, scores, window_frac, max_fraction, safety_margin)
        keep = F.col("score") > F.col("__g.threshold")
    else:
        raise ValueError("method must be slope, tail or rolling")
    cut = stage(cut, "elbow")
    flagged = with_scalars(scores, cut).agg(
        F.sum(F.when(keep, F.col("c")).otherwise(0)).alias("n_flagged"), F.sum("c").alias("n"))
    return with_scalars(flagged, cut).select(F.col("__g.threshold").alias("threshold"), "n_flagged", "n")


BLOCK = 65_536  # positions that one row of a run is laid out to


def _sorted_gaps(ranked: DataFrame) -> DataFrame:
    """(i, v, at): the gap after the i-th sorted score, and that score.

    A value with n copies ends one real gap and n - 1 gaps of zero. Runs of copies are cut into blocks of positions, and
    the blocks are dealt out before they are laid out.
    """
    runs = ranked.select(
        (F.col("below") - 1).alias("a"), (F.col("below") + F.col("n") - 2).alias("b"),
        F.coalesce(F.col("score") - F.col("prev"), F.lit(0.0)).alias("gap"), F.coalesce("prev", "score").alias("before"),
        "score").filter("b >= 0")
    block = F.explode(F.sequence(F.floor(F.greatest("a", F.lit(0)) / BLOCK), F.floor(F.col("b") / BLOCK)))
    n = int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = runs.withColumn("block", block).repartition(n, "block", "a")
    first = F.greatest(F.col("a"), F.col("block") * BLOCK, F.lit(0))
    last = F.least(F.col("b"), (F.col("block") + 1) * BLOCK - 1)
    rows = cut.withColumn("i", F.explode(F.sequence(first, last)))
    return rows.select("i", F.when(F.col("i") == F.col("a"), F.col("gap")).otherwise(0.0).alias("v"),
                       F.when(F.col("i") == F.col("a"), F.col("before")).otherwise(F.col("score")).alias("at"))


def _rolling_elbow(ranked: DataFrame, scores: DataFrame, window_frac: float, max_fraction: float,
                   margin: float) -> DataFrame:
    """The score before the first gap that is large against the median of the gaps in the window before it."""
    ranked = stage(ranked, "ranked")
    n = ranked.agg(F.max("total").alias("n"), F.max("score").alias("top")).first()
    gaps = (n.n or 0) - 1
    if gaps < 1:
        return scores.agg(F.max("score").alias("threshold"))
    window = max(1, int(gaps * window_frac))
    laid = stage(_sorted_gaps(ranked), "gaps")
    medians = window_medians(laid.select("i", "v"), window)
    met = lookup(medians, laid, ["i"])
    scored = stage(met.select("i", "at", (F.col("v") / (F.col("median") + 1e-12)).alias("ratio")), "ratios")
    counted = ordered_values(scored, [], "ratio")
    rank = F.ceil((1 - max_fraction) * F.col("total")) - 1
    limit = counted.filter((F.col("below") <= rank) & (rank < F.col("below") + F.col("n")))
    limit = limit.select((F.col("ratio") * (1 + margin)).alias("t"))
    hit = with_scalars(scored, limit).filter(F.col("ratio") >= F.col("__g.t"))
    return hit.agg(F.coalesce(F.min_by("at", "i"), F.lit(n.top)).alias("threshold"))


def tail_summary(df: DataFrame, score: str, qs: tuple[float, ...] = (0.01, 0.05, 0.10)) -> DataFrame:
    """(quantile, n_rows, score): size and lowest score of the top shares."""
    ranked = stage(ordered_values(counted_scores(df, score), [], "score", weight="c"), "ranked")
    total = F.col("total")
    parts = [
        F.struct(F.lit(q).alias("quantile"), (F.ceil((1 - q) * total) - 1).cast("long").alias("at")) for q in sorted(qs)]
    hits = ranked.select("score", "below", "n", "total", F.inline(F.array(*parts)))
    hits = hits.filter((F.col("below") <= F.col("at")) & (F.col("at") < F.col("below") + F.col("n")))
    return hits.select("quantile", (total - F.col("at")).alias("n_rows"), "score")
