"""Detectors with one contract: ``fit(df)`` gives a model whose ``score(df)`` adds a column, higher = more unusual."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from .encoders import Standardizer
from .scoring import apply_profile, fit_profile, recon_error
from .skew import lookup, ordered_values, running, spread_lookup


class Model(Protocol):
    def score(self, df: DataFrame, out: str = "score") -> DataFrame: ...


class Detector(Protocol):
    name: str

    def fit(self, df: DataFrame) -> Model: ...


class ProfileDetector:
    """Mean squared distance from the median profile of the row's key (or of all rows)."""

    name = "profile"

    def __init__(self, features: list[str], keys: list[str] = ()):
        self.features, self.keys = features, list(keys)

    def fit(self, df: DataFrame) -> "ProfileDetector":
        fitted = ProfileDetector(self.features, self.keys)
        fitted.overall = stage(fit_profile(df, self.features, []), "overall")
        fitted.profile = stage(fit_profile(df, self.features, self.keys), "profile") if self.keys else None
        return fitted

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        if self.profile is None:
            from .skew import with_scalars
            rows = with_scalars(df, self.overall)
            return rows.withColumn(out, recon_error(self.features, pred="__g.p_{}")).drop("__g")
        rows = apply_profile(df, self.profile, self.overall, self.features, self.keys, stored=True)
        return rows.select(*df.columns, recon_error(self.features).alias(out))


class PcaDetector:
    """Reconstruction error of a linear projection, fitted on standardised features."""

    name = "pca"

    def __init__(self, features: list[str], k: int = 3):
        self.features, self.k = features, k

    def _vector(self, df: DataFrame) -> DataFrame:
        scaled = self.scaler.transform(df.select(*[F.col(c).cast("double").alias(c) for c in self.features], "__row"))
        return VectorAssembler(inputCols=self.features, outputCol="__x").transform(scaled)

    def fit(self, df: DataFrame) -> "PcaDetector":
        fitted = PcaDetector(self.features, self.k)
        fitted.scaler = Standardizer(self.features).fit(df)
        rows = fitted._vector(df.withColumn("__row", F.lit(0)))
        fitted.model = PCA(k=self.k, inputCol="__x", outputCol="__z").fit(rows)
        return fitted

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """The axes are orthonormal, so the error is the squared length minus that of the projection."""
        rows = df.withColumn("__row", F.struct(*df.columns))
        projected = self.model.transform(self._vector(rows))

        def length(c: str):
            return F.aggregate(vector_to_array(c), F.lit(0.0), lambda a, v: a + v * v)

        error = F.greatest(F.lit(0.0), length("__x") - length("__z")) / float(len(self.features))
        return projected.select("__row.*", error.alias(out))


class TailDetector:
    """Empirical tail probabilities by feature, left, right, and the tail that the skew of the feature points to.

    ``kind`` is ``ecod`` (the largest of the three sums of -log probability over the features) or ``copod`` (the sum of
    the larger of the skew-chosen one and the mean of both). Probabilities are the shares of the training and scored rows
    together that are at most / at least the value. The model is the counted distribution of each feature and its
    moments; scoring orders the new values and looks their ranks up in it.
    """

    def __init__(self, features: list[str], id_col: str, kind: str = "ecod", values: DataFrame | None = None,
                 moments: DataFrame | None = None):
        if kind not in ("ecod", "copod"):
            raise ValueError("kind must be ecod or copod")
        self.features, self.id_col, self.values, self.moments = features, id_col, values, moments
        self.kind = self.name = kind

    def _long(self, df: DataFrame, ids: list[str] = ()) -> DataFrame:
        rows = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in self.features])
        return rows.unpivot(list(ids), self.features, "feature", "value").filter("value is not null")

    def _distribution(self, long: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Distinct values with n, below and total; and count, mean, squared and cubed deviations of each feature."""
        ranked = ordered_values(long, ["feature"], "value").select("feature", "value", "n", "below", "total")
        ranked = stage(ranked, "tail-values")
        weight = F.col("n").cast("double")
        means = ranked.groupBy("feature").agg(F.sum(weight).alias("c"), (F.sum(weight * F.col("value")) / F.sum(weight)).alias("m"))
        off = lookup(ranked, stage(means, "means"), ["feature"], hint=True)  # one row for each feature
        gap = F.col("value") - F.col("m")
        moments = off.groupBy("feature", "c", "m").agg(F.sum(weight * gap * gap).alias("s2"), F.sum(weight * gap * gap * gap).alias("s3"))
        return ranked, stage(moments, "moments")

    def fit(self, df: DataFrame) -> "TailDetector":
        return TailDetector(self.features, self.id_col, self.kind, *self._distribution(self._long(df)))

    def _with_model(self, own: DataFrame, moments: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The ranks of the new values among training and new rows, and the moments of both."""
        mine = own.withColumn("side", F.lit(1))
        theirs = self.values.select("feature", "value", F.struct("value", "below", "n").alias("seen")).withColumn("side", F.lit(0))
        laid = theirs.unionByName(mine, allowMissingColumns=True)
        met = running(laid, ["feature"], ["value", "side"], {"last": ("max", F.col("seen"))}).filter("side = 1")
        met = lookup(met, self.moments.select("feature", F.col("c").cast("long").alias("known")), ["feature"], hint=True)
        upto = F.coalesce(F.col("last.below") + F.col("last.n"), F.lit(0))
        under = F.when(F.col("last.value") == F.col("value"), F.col("last.below")).otherwise(upto)
        ranked = met.select("feature", "value", (F.col("below") + under).alias("below"),
                            (F.col("below") + F.col("n") + upto).alias("upto"), (F.col("total") + F.coalesce("known", F.lit(0))).alias("total"))
        a = moments.select("feature", F.struct("c", "m", "s2", "s3").alias("a"))
        b = self.moments.select("feature", F.struct("c", "m", "s2", "s3").alias("b"))
        both = lookup(a, b, ["feature"])
        na, nb, d = F.col("a.c"), F.col("b.c"), F.col("b.m") - F.col("a.m")
        n = na + nb
        s2 = F.col("a.s2") + F.col("b.s2") + d * d * na * nb / n
        s3 = (F.col("a.s3") + F.col("b.s3") + d * d * d * na * nb * (na - nb) / (n * n)
              + 3 * d * (na * F.col("b.s2") - nb * F.col("a.s2")) / n)
        known = F.col("b").isNotNull()
        return ranked, both.select("feature", F.when(known, n).otherwise(na).alias("c"), F.when(known, s2).otherwise(F.col("a.s2")).alias("s2"),
                                   F.when(known, s3).otherwise(F.col("a.s3")).alias("s3"))

    def score(self, df: DataFrame, out: str = "score", with_train: bool = True) -> DataFrame:
        own, moments = self._distribution(self._long(df))
        ranked = own.withColumn("upto", F.col("below") + F.col("n"))
        if with_train and self.values is not None:
            ranked, moments = self._with_model(own, moments)
        left = -F.log(F.col("upto") / F.col("total"))
        right = -F.log((F.col("total") - F.col("below")) / F.col("total"))
        tails = lookup(ranked, moments.select("feature", (F.col("s3") < 0).alias("low")), ["feature"], hint=True).select(
            "feature", "value", left.alias("left"), right.alias("right"), F.when(F.col("low"), left).otherwise(right).alias("auto"))
        scored = spread_lookup(self._long(df, [self.id_col]), stage(tails, "tails"), ["feature", "value"])
        total = F.greatest(F.sum("left"), F.sum("right"), F.sum("auto"))
        if self.kind == "copod":
            total = F.sum(F.greatest(F.col("auto"), (F.col("left") + F.col("right")) / 2))
        return lookup(df, scored.groupBy(self.id_col).agg(total.alias(out)), [self.id_col])


def _grow(x: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes (feature, cut, left, right, size) of one isolation tree; feature -1 marks a leaf."""
    nodes: list[tuple] = []

    def split(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, -1, -1, len(rows)))
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            return at
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        mask = rows[:, f] < cut
        a, b = split(rows[mask], depth + 1), split(rows[~mask], depth + 1)
        nodes[at] = (f, cut, a, b, len(rows))
        return at

    split(x, 0)
    return nodes


def _average_path(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    long = 2.0 * (np.log(safe - 1.0 + 1e-12) + 0.5772156649015329) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


class ForestDetector:
    """Isolation forest: each tree is grown in a task from about 256 hashed rows, and the small trees score all rows.

    With ``seeds`` a forest is grown for each seed, all in one job, and a row is scored by the one of its ``seed``.
    """

    name = "forest"

    def __init__(self, features: list[str], id_col: str, trees: int = 100, sample: int = 256, seed: int = 0,
                 seeds: tuple[int, ...] = ()):
        self.features, self.id_col, self.n_trees, self.sample = features, id_col, trees, sample
        self.seeds, self.by_row = tuple(seeds) or (seed,), bool(seeds)

    def fit(self, df: DataFrame) -> "ForestDetector":
        features, trees, sample = self.features, self.n_trees, self.sample
        n = max(1, df.count())
        wanted = sample * trees
        copies = max(1, min(trees, -(-wanted // n)))
        keep = min(1.0, wanted / n)
        rows = df.select(F.col(self.id_col).alias("__id"), *[F.col(c).cast("double").alias(c) for c in features])
        rows = rows.withColumn("__seed", F.explode(F.array(*map(F.lit, self.seeds))))
        rows = rows.withColumn("h", F.xxhash64("__id", "__seed"))
        rows = rows.filter(F.pmod(F.col("h"), F.lit(1 << 30)) < F.lit(int(keep * (1 << 30))))
        offset = F.pmod(F.xxhash64("h"), F.lit(trees))
        rows = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        rows = rows.withColumn("tree", F.pmod(offset + F.col("tree"), F.lit(trees)).cast("int"))
        limit = int(np.ceil(np.log2(max(2, sample))))

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            tree, seed = int(pdf["tree"].iloc[0]), int(pdf["__seed"].iloc[0])
            x = pdf.sort_values("h")[features].to_numpy()
            nodes = _grow(x, limit, np.random.default_rng([seed, tree]))
            out = pd.DataFrame(nodes, columns=["f", "cut", "a", "b", "size"])
            out.insert(0, "node", range(len(out)))
            out.insert(0, "tree", tree)
            out.insert(0, "seed", seed)
            return out

        grown = rows.groupBy("__seed", "tree").applyInPandas(
            grow, "seed int, tree int, node int, f int, cut double, a int, b int, size int")
        fitted = ForestDetector(features, self.id_col, trees, sample, self.seeds[0], self.seeds if self.by_row else ())
        # At most seeds * trees * 2^(depth + 1) nodes reach the driver.
        table = grown.toPandas().sort_values(["seed", "tree", "node"])
        fitted.nodes = {int(s): [g[["f", "cut", "a", "b", "size"]].to_numpy(dtype=float) for _, g in forest.groupby("tree")]
                        for s, forest in table.groupby("seed")}
        return fitted

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        forests = df.sparkSession.sparkContext.broadcast(self.nodes)
        norm = float(_average_path(np.array([self.sample]))[0])

        def depths(x: np.ndarray, trees: list) -> np.ndarray:
            total = np.zeros(len(x))
            for nodes in trees:
                at, depth = np.zeros(len(x), dtype=int), np.zeros(len(x))
                active = nodes[at, 0] >= 0
                while active.any():
                    idx = np.flatnonzero(active)
                    here = nodes[at[idx]]
                    left = x[idx, here[:, 0].astype(int)] < here[:, 1]
                    at[idx] = np.where(left, here[:, 2], here[:, 3]).astype(int)
                    depth[idx] += 1
                    active[idx] = nodes[at[idx], 0] >= 0
                total += depth + _average_path(nodes[at, 4])
            return np.power(2.0, -total / max(1, len(trees)) / norm)

        @F.pandas_udf("double")
        def path(seed: pd.Series, cols: pd.DataFrame) -> pd.Series:
            x, scores = cols.to_numpy(dtype=float), np.zeros(len(cols))
            for s in np.unique(seed):
                mine = (seed == s).to_numpy()
                scores[mine] = depths(x[mine], forests.value.get(int(s), []))
            return pd.Series(scores)

        seed = F.col("seed").cast("int") if self.by_row else F.lit(self.seeds[0])
        return df.withColumn(out, path(seed, F.struct(*[F.col(c).cast("double").alias(c) for c in self.features])))
