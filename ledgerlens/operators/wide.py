"""Categories as sparse vectors: every column is a group of positions with an offset, of which a row has at most one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from .encoders import hash_bin
from .skew import lookup, positions, spread_lookup


class WideEncoder:
    """Columns with at most ``max_onehot`` values get a position for each value, others ``hash_bins`` hashed ones.

    Values and positions stay in a table, so a group may be as wide as its column. ``layout`` has a (name, offset, size,
    hashed) for each column. ``transform`` adds the array ``active``: for each group the row's position in it, or -1 for
    a value that was not there when the encoder was fitted (or is missing).
    """

    def __init__(self, max_onehot: int = 10, hash_bins: int = 32):
        self.max_onehot, self.hash_bins = max_onehot, hash_bins

    def fit(self, df: DataFrame, cols: list[str]) -> "WideEncoder":
        texts = F.array(*[F.col(c).cast("string") for c in cols])
        values = stage(df.select(F.posexplode(texts).alias("g", "value")).filter("value is not null").distinct(), "values")
        sizes = {r.g: r["count"] for r in values.groupBy("g").count().collect()}  # a row for each column
        self.cols, self.layout, offset = cols, [], 0
        for g, c in enumerate(cols):
            hashed = sizes.get(g, 0) > self.max_onehot
            size = self.hash_bins if hashed else sizes.get(g, 0)
            self.layout.append((c, offset, size, hashed))
            offset += size
        plain = [g for g, (_, _, _, hashed) in enumerate(self.layout) if not hashed]
        numbered = positions(values.filter(F.col("g").isin(plain)), ["g"], ["value"], "i", stored=True)
        self.places = stage(numbered.select("g", "value", (F.col("i") - 1).cast("int").alias("i")), "places")
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out, active = df, []
        for g, (c, _, _, hashed) in enumerate(self.layout):
            if hashed:
                active.append(F.coalesce(hash_bin(c, self.hash_bins), F.lit(-1)))
                continue
            places = self.places.filter(F.col("g") == g).select(F.col("value").alias("__value"), F.col("i").alias(f"__i_{g}"))
            out = stage(spread_lookup(out.withColumn("__value", F.col(c).cast("string")), places, ["__value"]).drop("__value"), "encoded")
            active.append(F.coalesce(f"__i_{g}", F.lit(-1)))
        return out.select(*df.columns, F.array(*active).alias("active"))

    def _per_group(self, value) -> Column:
        return F.get(F.array(*[F.lit(value(entry)) for entry in self.layout]), F.col("g"))

    def vectors(self, df: DataFrame) -> DataFrame:
        """Add ``indices``: the positions in the whole vector that are 1, and its ``size``."""
        shifted = F.transform("active", lambda i, g: F.when(i >= 0, i + F.get(F.array(*[F.lit(e[1]) for e in self.layout]), g)))
        total = sum(e[2] for e in self.layout)
        return df.withColumns({"indices": F.filter(shifted, lambda i: i.isNotNull()), "size": F.lit(total)})


class CategoryProfile:
    """Expected vector of each key: the share of its rows at every position that occurs."""

    def __init__(self, encoder: WideEncoder, keys: list[str]):
        self.encoder, self.keys = encoder, keys

    def _long(self, encoded: DataFrame, carry: list[str]) -> DataFrame:
        return encoded.select(*carry, *self.keys, F.posexplode("active").alias("g", "i"))

    def fit(self, encoded: DataFrame) -> "CategoryProfile":
        """(keys, g, i, p), and by group the sum of squares and the position with the largest share (the first on a tie)."""
        counts = self._long(encoded, []).groupBy(*self.keys, "g", "i").agg(F.count(F.lit(1)).alias("c"))
        totals = counts.groupBy(*self.keys, "g").agg(F.sum("c").alias("t"))
        shares = lookup(counts, totals, [*self.keys, "g"], null_safe=True).filter("i >= 0")
        self.shares = stage(shares.select(*self.keys, "g", "i", (F.col("c") / F.col("t")).alias("p")), "shares")
        self.groups = stage(self.shares.groupBy(*self.keys, "g").agg(
            F.sum(F.col("p") * F.col("p")).alias("q"), F.max_by("i", F.struct("p", -F.col("i"))).alias("best")), "groups")
        return self

    def errors(self, encoded: DataFrame, id_col: str) -> DataFrame:
        """(id, g, group, err, expected): squared error over a group's positions, and the label the profile expects.

        A row's vector has one 1 in the group at most, so the error is q - 2 p + 1 with the share p at that position, and
        q without one. A key without a profile has no expectation. The label of a hashed group is its bin.
        """
        rows = stage(self._long(encoded, [id_col]), "active")
        met = spread_lookup(rows, self.shares, [*self.keys, "g", "i"], null_safe=True)
        met = spread_lookup(stage(met, "shares-met"), self.groups, [*self.keys, "g"], null_safe=True)
        err = F.coalesce("q", F.lit(0.0)) + F.when(F.col("i") >= 0, 1 - 2 * F.coalesce("p", F.lit(0.0))).otherwise(0.0)
        labels = self.encoder.places.select("g", F.col("i").alias("best"), F.col("value").alias("label"))
        named = spread_lookup(met.withColumn("err", err), labels, ["g", "best"])
        expected = F.when(self.encoder._per_group(lambda e: e[3]), F.concat(F.lit("bin "), F.col("best").cast("string"))).otherwise(F.col("label"))
        return named.select(id_col, "g", self.encoder._per_group(lambda e: e[0]).alias("group"), "err", expected.alias("expected"))

    def explain(self, encoded: DataFrame, id_col: str, k: int = 3) -> DataFrame:
        """(id, top_groups, expected): the k groups with the largest error, largest first, and the expected labels."""
        rows = self.errors(encoded, id_col)
        entry = F.struct("err", (-F.col("g")).alias("g"), "group", "expected")
        ordered = F.sort_array(F.collect_list(entry), asc=False)  # an entry for each encoded column
        out = rows.groupBy(id_col).agg(ordered.alias("all"))
        return out.select(id_col, F.slice("all", 1, k).alias("top_groups"), F.map_from_entries(
            F.transform("all", lambda e: F.struct(e["group"], e["expected"]))).alias("expected"))
