"""Distribution drift, required sample sizes for new pairs, learning curves and drift views."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..storage import stage
from .baselines import normalize_amount
from .skew import lookup, percentiles, positions, running, spread_lookup, with_scalars

EPS = 1e-6


def _long(df: DataFrame, ids: list[str], cols: list[str]) -> DataFrame:
    typed = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    return typed.unpivot(ids, cols, "feature", "value").filter(F.col("value").isNotNull() & ~F.isnan("value"))


def _bin(edges: Column, value: Column) -> Column:
    """Index of the half-open bin, the last one closed; null outside the edges."""
    low, high = F.get(edges, 0), F.element_at(edges, -1)
    passed = F.size(F.filter(edges, lambda e: e <= value))
    return F.when((value < low) | (value > high), None).when(value == high, F.size(edges) - 2).otherwise(passed - 1)


def psi(ref: DataFrame, new: DataFrame, cols: list[str], keys: list[str] = (), cells: list[str] = (),
        bins: int = 10) -> DataFrame:
    """Population stability index per cell and column.

    ``keys`` name the reference group and are in both tables; ``cells`` further divide the new rows, so that many new
    cells share the binning of one reference group. 0 below 10 reference rows, 2 new rows or 3 distinct edges.
    """
    keys, cells = list(keys), list(cells)
    probs = {f"e{i}": i / bins for i in range(bins + 1)}
    ref_long, new_long = _long(ref, keys, cols), _long(new, keys + cells, cols)
    q = percentiles(ref_long, [*keys, "feature"], "value", probs)
    edges = stage(q.select(*keys, "feature", F.col("n").alias("n_ref"),
                           F.array_distinct(F.array(*[F.col(p) for p in probs])).alias("edges")), "edges")

    def binned(long: DataFrame, ids: list[str], name: str) -> DataFrame:
        placed = spread_lookup(long, edges.select(*keys, "feature", "edges"), [*keys, "feature"])
        placed = placed.withColumn("bin", _bin(F.col("edges"), F.col("value")))
        return placed.groupBy(*ids, "feature", "bin").agg(F.count(F.lit(1)).alias(name))

    ref_bins = binned(ref_long, keys, "c_ref")
    new_bins = stage(binned(new_long, keys + cells, "c_new"), "new-bins")
    n_new = new_bins.groupBy(*keys, *cells, "feature").agg(F.sum("c_new").alias("n_new"))
    grid = lookup(n_new, edges, [*keys, "feature"]).filter("edges is not null")
    last = F.greatest(F.size("edges") - 2, F.lit(0))
    grid = grid.withColumn("bin", F.explode(F.sequence(F.lit(0), last)))
    full = lookup(lookup(grid, ref_bins, [*keys, "feature", "bin"]), new_bins, [*keys, *cells, "feature", "bin"])
    full = full.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("c_ref", "c_new")})
    group = Window.partitionBy(*keys, *cells, "feature")
    shares = {p: F.col(c) / F.greatest(F.sum(c).over(group), F.lit(1)) for p, c in (("p_ref", "c_ref"), ("p_new", "c_new"))}
    part = (F.col("p_new") - F.col("p_ref")) * F.log((F.col("p_new") + EPS) / (F.col("p_ref") + EPS))
    total = full.withColumns(shares).groupBy(*keys, *cells, "feature").agg(
        F.abs(F.sum(part)).alias("value"), F.first("n_ref").alias("n_ref"), F.first("n_new").alias("n_new"),
        F.first(F.size("edges")).alias("n_edges"))
    enough = (F.col("n_ref") >= 10) & (F.col("n_new") >= 2) & (F.col("n_edges") >= 3)
    return total.select(*keys, *cells, "feature", F.when(enough, F.col("value")).otherwise(0.0).alias("psi"))


def variance_ratio(ref: DataFrame, new: DataFrame, cols: list[str], keys: list[str] = (), cells: list[str] = ()
                   ) -> DataFrame:
    """sqrt(var_new / var_ref), at least 1; 1 below 5 reference or 2 new rows or without reference variance."""
    keys, cells = list(keys), list(cells)

    def moments(long: DataFrame, ids: list[str], tag: str) -> DataFrame:
        return long.groupBy(*ids, "feature").agg(F.count(F.lit(1)).alias(f"n_{tag}"), F.var_samp("value").alias(f"v_{tag}"))

    both = lookup(moments(_long(new, keys + cells, cols), keys + cells, "new"),
                  moments(_long(ref, keys, cols), keys, "ref"), [*keys, "feature"])
    usable = (F.col("n_ref") >= 5) & (F.col("n_new") >= 2) & (F.col("v_ref") > 0)
    ratio = F.sqrt(F.greatest(F.col("v_new") / F.col("v_ref"), F.lit(1.0)))
    return both.select(*keys, *cells, "feature", F.coalesce(F.when(usable, ratio), F.lit(1.0)).alias("variance_ratio"))


def psi_factor(col: Column) -> Column:
    return F.when(col < 0.10, 1.0).when(col < 0.25, 1.2).when(col < 0.50, 1.5).otherwise(2.0)


def inflation(psi_table: DataFrame, ratios: DataFrame, keys: list[str], cap: float = 3.0) -> DataFrame:
    """Geometric mean over the columns of the larger of both factors, capped."""
    both = lookup(psi_table, ratios, [*keys, "feature"])
    factor = F.greatest(F.col("variance_ratio"), psi_factor(F.col("psi")), F.lit(1.0))
    return both.groupBy(*keys).agg(F.least(F.exp(F.avg(F.log(factor))), F.lit(cap)).alias("vif"))


def error_stats(df: DataFrame, col: str, err: str) -> DataFrame:
    """Count, mean and variance of the error per value of one column."""
    return df.groupBy(col).agg(F.count(err).alias("count"), F.avg(err).alias("mean"), F.var_samp(err).alias("var"))


def pooled_sigma(pairs: DataFrame, units: DataFrame, parties: DataFrame, overall: DataFrame, bu: str, cp: str,
                 out: str = "sigma") -> DataFrame:
    """Root of the count-weighted mean of both marginal variances, else the overall deviation."""
    joined = pairs
    for col, table, t in ((bu, units, "u"), (cp, parties, "p")):
        joined = lookup(joined, table.select(col, F.col("count").alias(f"__n{t}"), F.col("var").alias(f"__v{t}")), [col])
    joined = with_scalars(joined, overall)
    weights = [F.when(F.col(f"__v{t}").isNotNull(), F.greatest(F.col(f"__n{t}"), F.lit(1))).otherwise(0) for t in "up"]
    total = weights[0] + weights[1]
    mean = sum((w * F.coalesce(F.col(f"__v{t}"), F.lit(0.0)) for w, t in zip(weights, "up")), F.lit(0.0))
    sigma = F.when(total > 0, F.sqrt(F.greatest(mean / total, F.lit(0.0)))).otherwise(
        F.coalesce(F.col("__g.sigma"), F.lit(1.0)))
    return joined.select(*pairs.columns, sigma.alias(out))


def required_n(sigma: Column, precision: float, z: float = 1.96, floor: int = 30, relative: bool = False) -> Column:
    """ceil((z sigma / delta)^2), at least ``floor``; a relative precision is a share of sigma."""
    delta = F.greatest((sigma if relative else F.lit(1.0)) * precision, F.lit(1e-12))
    return F.greatest(F.ceil(F.pow(z * sigma / delta, 2)).cast("long"), F.lit(floor).cast("long"))


def matched_cohort(cells: DataFrame, history: DataFrame, cell_keys: list[str], match: list[str]) -> DataFrame:
    """(cell keys, match columns): modal values per cell where history holds them, else ``*`` for all history."""
    modal = cells.groupBy(*cell_keys).agg(*[F.mode(F.col(c).cast("string"), True).alias(c) for c in match])
    known = history.select(*[F.col(c).cast("string").alias(c) for c in match]).distinct().withColumn("__hit", F.lit(1))
    found = spread_lookup(modal, known, match)
    return found.select(*cell_keys, *[F.when(F.col("__hit") == 1, F.col(c)).otherwise("*").alias(c) for c in match])


@dataclass
class RecommendConfig:
    bu: str = "BUnit"
    cp: str = "Cpty"
    numeric: list[str] = field(default_factory=lambda: ["BuyAmount", "SellAmount"])
    match: list[str] = field(default_factory=lambda: ["FX_Instrument_Type", "BuyCurr", "SellCurr"])
    precision: float = 0.25
    z: float = 1.96
    floor: int = 30
    bins: int = 10
    min_recent: int = 5
    cap: float = 3.0
    empirical: bool = False
    id_col: str = "UniqueId"
    features: list[str] = field(default_factory=lambda: ["BuyAmount"])
    step_k: int = 10
    prior_rows: int = 30
    bootstraps: int = 5
    probe: int = 8
    min_improvement: float = 0.05
    max_cv: float = 0.20
    seed: int = 42


def cell_inflation(history: DataFrame, cells: DataFrame, cfg: RecommendConfig) -> DataFrame:
    """Inflation factor per new pair against its matched cohort, for all pairs at once.

    Pairs with the same modal values share a cohort, so history is summarised per cohort and once as a whole.
    """
    pair = [cfg.bu, cfg.cp]
    typed = history.withColumns({c: F.col(c).cast("string") for c in cfg.match})
    cohort = stage(matched_cohort(cells, typed, pair, cfg.match), "cohorts")
    names = [f"__m{i}" for i in range(len(cfg.match))]
    cohort = cohort.select(*pair, *[F.col(c).alias(n) for c, n in zip(cfg.match, names)])
    rows = stage(spread_lookup(cells.select(*pair, *cfg.numeric), cohort, pair), "cells")
    first = F.col(names[0])
    wanted = cohort.filter(first != "*").select(*names).distinct()
    ref = typed.select(*[F.col(c).alias(n) for c, n in zip(cfg.match, names)], *cfg.numeric)
    ref = lookup(ref, wanted, names, how="left_semi")
    own, rest = rows.filter(first != "*"), rows.filter(first == "*").drop(*names)
    parts = []
    for r, n, keys in ((ref, own, names), (typed.select(*cfg.numeric), rest, [])):
        ratios = variance_ratio(r, n, cfg.numeric, keys, pair)
        parts.append(inflation(psi(r, n, cfg.numeric, keys, pair, cfg.bins), ratios, keys + pair, cfg.cap).select(*pair, "vif"))
    return parts[0].unionByName(parts[1])


def learning_curve(history: DataFrame, cells: DataFrame, cfg: RecommendConfig) -> DataFrame:
    """(pair, k, mean, std): error on a held-out probe after k = step, 2 step, ... rows of a new pair join the history.

    The model is a profile that merges: the pair's mean, with the history's mean standing for ``prior_rows`` rows. Rows are
    ranked by hashes of their id; the first ones are the probe, and each bootstrap ranks the rest anew, so the models of
    a bootstrap are prefixes of one order and their sums come from one running sum, up to all rows of the pair. The probe
    enters by its count, sums and squares. Pairs below ``floor`` rows, or too small for a step, have no curve.
    """
    pair = [cfg.bu, cfg.cp]
    values = {f"__x_{i}": F.col(c).cast("double") for i, c in enumerate(cfg.features)}

    def hashed(tag: Column | str) -> Column:
        return F.md5(F.concat_ws(":", F.col("__id"), F.lit(str(cfg.seed)), tag))

    rows = cells.select(*pair, F.col(cfg.id_col).cast("string").alias("__id"), *[c.alias(x) for x, c in values.items()])
    ranked = positions(rows.withColumn("__h", hashed(F.lit("probe"))), pair, ["__h", "__id"], "__pos")
    ranked = stage(ranked.filter(F.col("__pos_n") >= max(cfg.probe + cfg.step_k, cfg.floor)), "ranked")
    probe = ranked.filter(F.col("__pos") <= cfg.probe).groupBy(*pair).agg(F.count(F.lit(1)).alias("__c"), *[
        agg.alias(f"{x}{name}") for x in values for name, agg in (("_s", F.sum(x)), ("_q", F.sum(F.col(x) * F.col(x))))])
    pool = ranked.filter(F.col("__pos") > cfg.probe).select(
        *pair, "__id", *values, F.explode(F.sequence(F.lit(0), F.lit(cfg.bootstraps - 1))).alias("b"))
    pool = pool.withColumn("__h", hashed(F.col("b").cast("string")))
    sums = running(pool, [*pair, "b"], ["__h", "__id"], {
        "before": ("sum", F.lit(1).cast("long")), **{f"{x}_b": ("sum", F.col(x)) for x in values}})
    k = F.col("before") + 1
    models = sums.filter(k % cfg.step_k == 0).select(*pair, "b", k.alias("k"), *[(F.col(f"{x}_b") + F.col(x)).alias(x) for x in values])
    prior = history.agg(*[F.avg(c).alias(x) for x, c in values.items()])
    tried = with_scalars(lookup(models, probe, pair), prior)
    parts = []
    for x in values:
        p = (cfg.prior_rows * F.col(f"__g.{x}") + F.col(x)) / (F.col("k") + cfg.prior_rows)
        parts.append((F.col(f"{x}_q") - 2 * p * F.col(f"{x}_s") + F.col("__c") * p * p) / F.col("__c"))
    errors = tried.select(*pair, "k", (sum(parts[1:], parts[0]) / float(len(parts))).alias("e"))
    return errors.groupBy(*pair, "k").agg(F.avg("e").alias("mean"), F.coalesce(F.stddev_samp("e"), F.lit(0.0)).alias("std"))


def empirical_n(history: DataFrame, cells: DataFrame, cfg: RecommendConfig) -> DataFrame:
    """Rows per pair after which one more step no longer improves the probe; all full steps if none settles."""
    pair = [cfg.bu, cfg.cp]
    curve = stage(learning_curve(history, cells, cfg), "curve")
    steps = running(curve, pair, ["k"], {"last_k": ("max", F.struct("k", "mean"))}, stored=True)
    prev = F.col("last_k.mean")
    settled = ((prev - F.col("mean")) / F.greatest(prev, F.lit(1e-12)) < cfg.min_improvement) & (
        F.col("std") / F.greatest(F.col("mean"), F.lit(1e-12)) < cfg.max_cv)
    return steps.groupBy(*pair).agg(F.coalesce(F.min(F.when(settled, F.col("k"))), F.max("k")).cast("long").alias("empirical_n"))


def recommend(history: DataFrame, recent: DataFrame, cfg: RecommendConfig = RecommendConfig(), detector=None,
              err: str = "score") -> DataFrame:
    """Rows needed for each pair that is new in ``recent``, and how many are missing.

    ``detector`` (fit / score) gives history its errors; without one ``history`` already has the column ``err``.
    """
    pair = [cfg.bu, cfg.cp]
    history = stage(detector.fit(history).score(history, err) if detector else history, "history")
    fresh = recent.select(*pair).distinct().join(history.select(*pair).distinct(), pair, "left_anti")
    cells = stage(spread_lookup(recent, fresh.withColumn("__new", F.lit(1)), pair).filter("__new = 1").drop("__new"), "new")
    overall = history.agg(F.stddev_samp(err).alias("sigma"))
    pairs = cells.groupBy(*pair).agg(F.count(F.lit(1)).alias("available"))
    out = pooled_sigma(pairs, error_stats(history, cfg.bu, err), error_stats(history, cfg.cp, err), overall, cfg.bu, cfg.cp)
    out = lookup(out, cell_inflation(history, cells, cfg), pair)
    vif = F.when(F.col("available") < max(cfg.min_recent, 2), 1.0).otherwise(F.coalesce("vif", F.lit(1.0)))
    out = out.withColumn("vif", vif).withColumn("sigma_effective", F.col("sigma") * F.col("vif"))
    out = out.withColumn("analytical_n", required_n(F.col("sigma_effective"), cfg.precision, cfg.z, cfg.floor))
    if cfg.empirical:
        out = lookup(out, empirical_n(history, cells, cfg), pair)
    else:
        out = out.withColumn("empirical_n", F.lit(None).cast("long"))
    out = out.withColumn("recommended_n", F.greatest(F.col("analytical_n"), F.coalesce("empirical_n", F.lit(0).cast("long"))))
    return out.withColumn("shortfall", F.greatest(F.col("recommended_n") - F.col("available"), F.lit(0).cast("long")))


def recommend_summary(table: DataFrame) -> DataFrame:
    """Median and 80th percentile of the recommended sizes."""
    return percentiles(table, [], "recommended_n", {"median_recommended_n": 0.5, "p80_recommended_n": 0.8}).select(
        F.floor("median_recommended_n").alias("median_recommended_n"), F.floor("p80_recommended_n").alias("p80_recommended_n"))


def pick_examples(flagged: DataFrame, train: DataFrame, n: int = 3, offset: int = 0, score: str = "recon_error",
                  keys: list[str] = S.KEYS, tie: tuple[str, ...] = ()) -> DataFrame:
    """The first n flagged rows from ``offset`` on, by falling score, whose combination was in training."""
    ranked = positions(flagged, [], [f"-{score}", *tie], "rank").filter(F.col("rank") > offset).drop("rank_n")
    known = lookup(ranked, train.select(*keys).distinct(), keys, how="left_semi")
    return known.orderBy("rank").limit(n)


def drift_series(train: DataFrame, flagged: DataFrame, stats: DataFrame, overall: DataFrame, n: int = 3, offset: int = 0,
                 keys: list[str] = S.KEYS, tie: tuple[str, ...] = ()) -> DataFrame:
    """Long table (keys, series, ts, value) for the combinations of the picked examples.

    Series: amounts in training, flagged amounts and their predictions, the same in normalised units, and absolute
    amounts; the normalised bands are at -2, -1, 1 and 2.
    """
    combos = pick_examples(flagged, train, n, offset, keys=keys, tie=tie).select(*keys).distinct()
    past = lookup(train.select(*keys, "ts", "amount"), combos, keys, how="left_semi")
    seen = lookup(flagged, combos, keys, how="left_semi")
    predicted = seen.select(*keys, "ts", F.col("amount_pred").alias("amount"))
    seen = seen.select(*keys, "ts", "amount")
    parts = []
    for name, rows in (("train", past), ("actual", seen), ("predicted", predicted)):
        norm = normalize_amount(rows, stats, overall, keys, stored=True)
        parts += [norm.select(*keys, F.lit(f"{name} amount").alias("series"), "ts", F.col("amount").alias("value")),
                  norm.select(*keys, F.lit(f"{name} y_norm").alias("series"), "ts", F.col("y_norm").alias("value"))]
        if name != "predicted":
            parts.append(norm.select(*keys, F.lit(f"{name} abs amount").alias("series"), "ts", F.abs("amount").alias("value")))
    bands = F.array(*[F.struct(F.lit(f"band {b:+d}").alias("series"), F.lit(None).cast("date").alias("ts"),
                               F.lit(float(b)).alias("value")) for b in (-2, -1, 1, 2)])
    parts.append(combos.select(*keys, F.inline(bands)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ellipses(df: DataFrame, keys: list[str], x: str, y: str, sigmas: tuple[float, ...] = (1.0, 2.0)) -> DataFrame:
    """Centre, axis lengths and angle of the covariance ellipse per key, for keys with at least 3 points."""
    m = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.var_samp(x).alias("vx"),
        F.var_samp(y).alias("vy"), F.covar_samp(x, y).alias("vxy")).filter("n >= 3")
    half = (F.col("vx") + F.col("vy")) / 2
    root = F.sqrt(F.pow((F.col("vx") - F.col("vy")) / 2, 2) + F.pow(F.col("vxy"), 2))
    axes = {f"{axis}_{int(s)}s": s * F.sqrt(F.greatest(e, F.lit(1e-12)))
            for s in sigmas for axis, e in (("major", half + root), ("minor", half - root))}
    angle = 0.5 * F.atan2(2 * F.col("vxy"), F.col("vx") - F.col("vy"))
    return m.select(*keys, "n", "mean_x", "mean_y", *[c.alias(a) for a, c in axes.items()], angle.alias("angle"))
