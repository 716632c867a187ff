"""Grouped building blocks that stay balanced when one key holds a large share of the rows.

A group counts as *hot* when it holds more than ``1 / hot_share`` of all rows, so there are never more than
``hot_share`` hot groups and their statistics can be broadcast whatever the size of the data. Ordinary groups use a
plain shuffle; hot groups are spread over many tasks and corrected with the broadcast statistics. Groups are counted
first, and without a hot one the steps that only serve hot groups are left out of the plan; sizes decide nothing. What
reads its input several times stores it first, unless ``stored`` says that it is a stored table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stage

COMBINE = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "min": lambda a, b: F.least(a, b),
    "max": lambda a, b: F.greatest(a, b),
}
AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_share(spark: SparkSession) -> int:
    """A group above ``1 / hot_share`` of the rows is larger than half a fair shuffle partition."""
    return max(8, 2 * _partitions(spark))


def bucket_count(spark: SparkSession) -> int:
    """Number of order buckets (a power of two, near the shuffle parallelism)."""
    n = 8
    while n < min(4096, _partitions(spark)):
        n *= 2
    return n


def lookup(df: DataFrame, table: DataFrame, keys: list[str], how: str = "left",
           null_safe: bool = False, hint: bool = False) -> DataFrame:
    """Join a one-row-per-key table to ``df`` without repeating the key columns.

    No broadcast is forced: the planner broadcasts a table it knows to be small and AQE splits skewed partitions.
    ``hint`` is for tables whose row count is bounded by construction.
    """
    right = table.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in table.columns if c not in keys]
    )
    if hint:
        right = F.broadcast(right)
    pairs = [
        F.col(k).eqNullSafe(F.col(f"__r_{k}")) if null_safe else F.col(k) == F.col(f"__r_{k}") for k in keys
    ]
    out = df.join(right, reduce(lambda a, b: a & b, pairs), how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__r_{k}" for k in keys])


def _hot(stats: DataFrame, n: str) -> DataFrame | None:
    """The groups that hold more than a fair share of all rows; None if there are none."""
    share = hot_share(stats.sparkSession)
    top = stats.agg(F.max(n).alias("most"), F.sum(n).alias("total")).first()
    if top.most is None or top.most * share <= top.total:
        return None
    return stats.filter(F.col(n) * F.lit(share) > F.lit(top.total))


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def spread(df: DataFrame) -> Column:
    """A salt that depends on the row and its input partition, so copies of one row spread too and retries agree."""
    values = [F.col(f"`{f.name}`") for f in df.schema if _hashable(f.dataType)]
    return F.pmod(F.xxhash64(*values, F.spark_partition_id()), F.lit(1 << 20)) + 1


def spread_lookup(df: DataFrame, table: DataFrame, keys: list[str], counts: DataFrame | None = None,
                  null_safe: bool = False, hashed: bool = False) -> DataFrame:
    """Left join a one-row-per-key table whose hot keys would overload a task.

    Hot keys, whether the table has them or not, are answered by a broadcast join and their rows are salted; so are rows
    with a null key where nulls match nothing. Other keys meet the table in a shuffle. ``counts`` (keys, ``__n`` rows of
    ``df``) avoids counting again. ``hashed`` keeps the table's part of each task in memory instead of sorting the rows.
    """
    names = [c for c in table.columns if c not in keys]
    if hashed:
        table = table.hint("shuffle_hash")
    if counts is None:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    hot_keys = _hot(counts, "__n")
    if hot_keys is None:
        return lookup(df, table, keys, null_safe=null_safe).select(*df.columns, *names)
    hot_keys = stage(hot_keys.select(*keys), "hot")  # a few keys; the plan refers to ``df`` once
    hot = lookup(table, hot_keys, keys, how="left_semi", null_safe=null_safe, hint=True)
    hot = hot.select(*keys, F.struct(*names).alias("__hot"))
    hot = lookup(hot_keys.withColumn("__is_hot", F.lit(True)), hot, keys, null_safe=null_safe)
    rows = lookup(df, hot, keys, null_safe=null_safe, hint=True)
    apart = F.col("__is_hot").isNotNull()
    if not null_safe:
        apart = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys], apart)
    rows = rows.withColumn("__s", F.when(apart, spread(df)).otherwise(F.lit(0)))
    cold = table.select(*keys, F.lit(0).cast("long").alias("__s"), F.struct(*names).alias("__cold"))
    out = lookup(rows, cold, keys + ["__s"], null_safe=null_safe)
    picked = out.withColumn("__v", F.coalesce("__hot", "__cold"))
    return picked.select(*df.columns, *[F.col(f"__v.{n}").alias(n) for n in names])


def group_context(df: DataFrame, keys: list[str], aggs: dict[str, Column], null_safe: bool = False) -> DataFrame:
    """Add grouped aggregates to every row (``transform`` of a group-by) with map-side partial aggregation."""
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[c.alias(n) for n, c in aggs.items()])
    return spread_lookup(df, stats.drop("__n"), keys, stats.select(*keys, "__n"), null_safe)


def with_scalars(df: DataFrame, row: DataFrame, name: str = "__g") -> DataFrame:
    """Add the only row of ``row`` to every row as a struct, as a scalar subquery (evaluated once, no join)."""
    return df.withColumn(name, row.select(F.struct(*row.columns)).scalar())


def sort_key(df: DataFrame, name: str) -> Column:
    """A value that never decreases along the order of the column; used only to cut the order into buckets."""
    kind = df.schema[name].dataType
    col = F.col(name)
    if isinstance(kind, T.StringType):
        return F.coalesce(col, F.lit(""))
    if isinstance(kind, T.DateType):
        key = F.unix_date(col).cast("double")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        key = F.unix_micros(col.cast("timestamp")).cast("double")
    else:
        key = col.cast("double")
    return F.coalesce(key, F.lit(float("-inf")))


def _edges(keyed: DataFrame, group: list[str], n: int) -> DataFrame:
    """``__e`` for each group: at most n - 1 rising values of ``__k`` that cut the group into about equal parts.

    Numbers have a quantile sketch. Strings have none, so a random sample of 32 values for each part is ordered; edges
    are stored, so every pass sees the same ones.
    """
    if not isinstance(keyed.schema["__k"].dataType, T.StringType):
        cut = keyed.groupBy(*group).agg(
            F.percentile_approx("__k", [i / n for i in range(1, n)], F.lit(8 * n)).alias("__e"), F.count(F.lit(1)).alias("__n"))
    else:
        sampled = F.rand(17) * keyed.count() < 32 * n
        values = keyed.filter(sampled).groupBy(*group).agg(
            F.sort_array(F.collect_list("__k")).alias("v"), F.count(F.lit(1)).alias("__n"))
        at = F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.get("v", F.floor(i * F.size("v") / n).cast("int")))
        cut = values.select(*group, at.alias("__e"), "__n")
    return stage(cut, "edges")


def _thinned(edges: DataFrame, group: list[str]) -> DataFrame:
    """As many edges for each group as its share of the rows asks for: some two for each bucket in all groups together."""
    total = edges.agg(F.sum("__n")).first()[0] or 1
    step = F.greatest(F.lit(1), F.floor(F.lit(total) / (F.lit(2) * F.col("__n"))).cast("int"))
    return edges.select(*group, F.filter("__e", lambda _, i: (i + 1) % step == 0).alias("__e"))


def with_bucket(df: DataFrame, name: str, ascending: bool = True, group: list[str] = (),
                hot: DataFrame | None = None) -> DataFrame:
    """Add ``__b``, the order bucket of a column: equal values share a bucket and buckets follow the order of the values.

    Without ``group`` the whole table is cut. With it, only the groups in ``hot`` (rows of them) are, and other rows have
    a null bucket. A binary search over the edges is unrolled into a chain of projections.
    """
    n, group = bucket_count(df.sparkSession), list(group)
    keyed = (df if hot is None else hot).withColumn("__k", sort_key(df, name))
    edges = _thinned(_edges(keyed, group, n), group)
    cut = df.withColumn("__k", sort_key(df, name))
    cut = lookup(cut, edges, group, null_safe=True, hint=True) if group else cut.withColumn("__e", edges.scalar())
    cut = cut.withColumn("__b", F.when(F.col("__e").isNotNull(), 0))
    step = n // 2
    while step:
        beyond = F.col("__k") > F.get(F.col("__e"), F.col("__b") + F.lit(step - 1))
        cut = cut.withColumn("__b", F.col("__b") + F.when(beyond, step).otherwise(0))
        step //= 2
    return cut.withColumn("__b", F.col("__b") * (1 if ascending else -1)).drop("__k", "__e")


def _order(order: list[str]) -> tuple[list[Column], str, bool]:
    cols = [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]
    return cols, order[0].lstrip("-"), not order[0].startswith("-")


def running(df: DataFrame, group: list[str], order: list[str], aggs: dict[str, tuple[str, Column]],
            totals: bool = False, stored: bool = False) -> DataFrame:
    """Running aggregates over the rows *before* each row of its group, in a total order.

    ``aggs`` maps a name to (``sum`` | ``min`` | ``max``, column); ``order`` takes names, ``-name`` for descending.
    With ``totals`` the aggregate over the whole group is added as ``<name>_total``. Rows are shuffled once. Hot groups,
    the null group among them (or the whole table when ``group`` is empty), are cut into order buckets, more for larger
    groups, so that no task holds more than a bucket of a hot group; the totals of the buckets, of which there are only a
    few for each shuffle partition, are broadcast. Edges only balance the work; any edges give the same results.
    """
    cols, first, ascending = _order(order)
    df = df if stored else stage(df, "running")
    rows = df
    for name, (_, c) in aggs.items():
        rows = rows.withColumn(f"__v_{name}", c)
    hot, part = rows, list(group)
    if group:
        hot_keys = _hot(df.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")), "__n")
        hot = None if hot_keys is None else lookup(rows, stage(hot_keys.select(*group), "hot"), group, "left_semi", True, True)
    if hot is not None:
        rows, part = with_bucket(rows, first, ascending, group, hot), [*group, "__b"]

    inside = Window.partitionBy(*part).orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*part)
    out = rows.withColumns({f"__w_{name}": AGG[op](f"__v_{name}").over(inside) for name, (op, _) in aggs.items()})
    if totals:
        out = out.withColumns({f"__a_{name}": AGG[op](f"__v_{name}").over(whole) for name, (op, _) in aggs.items()})
    value = {name: F.coalesce(f"__w_{name}", F.lit(0)) if op == "sum" else F.col(f"__w_{name}") for name, (op, _) in aggs.items()}
    total = {name: F.col(f"__a_{name}") for name in aggs}
    if hot is not None:
        sums = rows.withColumn("__cut", F.monotonically_increasing_id() >= 0)  # keeps the filter above the search
        sums = sums.filter(F.col("__cut") & F.col("__b").isNotNull()).groupBy(*part).agg(
            *[AGG[op](f"__v_{name}").alias(f"__p_{name}") for name, (op, _) in aggs.items()])
        before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        every = before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        offsets = sums.select(*part, *[AGG[op](f"__p_{name}").over(w).alias(f"__{side}_{name}")
                                       for name, (op, _) in aggs.items() for side, w in (("o", before), ("t", every))])
        out = lookup(out, offsets, part, null_safe=True, hint=True)
        value = {name: COMBINE[op](F.col(f"__o_{name}"), F.col(f"__w_{name}")) for name, (op, _) in aggs.items()}
        total = {name: F.when(F.col("__b").isNotNull(), F.col(f"__t_{name}")).otherwise(total[name]) for name in aggs}
    result = [value[name].alias(name) for name in aggs]
    if totals:
        result += [total[name].alias(f"{name}_total") for name in aggs]
    return out.select(*df.columns, *result)


def positions(df: DataFrame, group: list[str], order: list[str], out: str = "pos", stored: bool = False) -> DataFrame:
    """Add the 1-based position of each row in its group and the group size ``<out>_n``."""
    ranked = running(df, group, order, {out: ("sum", F.lit(1).cast("long"))}, totals=True, stored=stored)
    return ranked.withColumn(out, F.col(out) + 1).withColumnRenamed(f"{out}_total", f"{out}_n")


def ordered_values(df: DataFrame, keys: list[str], value: str, sums: dict[str, Column] | None = None,
                   weight: str | None = None) -> DataFrame:
    """Distinct values per group with ``n`` copies, ``below`` rows before them, ``total`` rows and the ``prev`` value.

    Rows are counted before anything is ordered, so copies of one value never travel together, and the counts are
    stored, so the rows are read once. ``weight`` names a column of row counts when ``df`` is already counted. Extra
    ``sums`` are carried as ``<name>``, ``<name>_below`` and ``<name>_total``.
    """
    sums = sums or {}
    clean = df.filter(F.col(value).isNotNull())
    counted = clean.groupBy(*keys, value).agg(
        F.sum(weight).alias("n") if weight else F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(s) for s, c in sums.items()])
    counted = stage(counted, "counted")
    aggs = {"below": ("sum", F.col("n")), "prev": ("max", F.col(value))}
    aggs.update({f"{s}_below": ("sum", F.col(s)) for s in sums})
    ranked = running(counted, keys, [value], aggs, totals=True, stored=True)
    ranked = ranked.withColumnRenamed("below_total", "total").drop("prev_total")
    for s in sums:
        ranked = ranked.withColumnRenamed(f"{s}_below_total", f"{s}_total")
    return ranked


def _value_bin(col: Column, bins: int) -> Column:
    """A number that never decreases along the order of the values: ``bins`` steps for each factor of e, by sign."""
    # The logarithm of the smallest number is above -746.
    return F.coalesce(F.signum(col) * F.floor((F.ln(F.abs(col)) + 746) * bins), F.lit(0.0))


def _binned(df: DataFrame, keys: list[str], cols: list[str], weight: str | None, bins: int) -> tuple[DataFrame, Column]:
    """A row (keys, ``__col``, ``__x``, ``__bin``) for each value of the columns, and their count."""
    values = F.array(*[F.struct(F.lit(i).alias("__col"), F.col(c).cast("double").alias("__x")) for i, c in enumerate(cols)])
    size = [F.col(weight).alias("__w")] if weight else []
    rows = df.select(*keys, *size, F.inline(values)) if len(cols) > 1 else df.select(
        *keys, *size, F.lit(0).alias("__col"), F.col(cols[0]).cast("double").alias("__x"))
    rows = rows.filter("__x is not null").withColumn("__bin", _value_bin(F.col("__x"), bins))
    return rows, (F.sum("__w") if weight else F.count(F.lit(1))).alias("__n")


def value_bins(df: DataFrame, keys: list[str], cols: list[str], weight: str | None = None, bins: int = 128) -> DataFrame:
    """Values of the columns counted by group and bin, stored; they also serve ``ranked_values`` by some of the keys."""
    rows, count = _binned(df, keys, cols, weight, bins)
    return stage(rows.groupBy(*keys, "__col", "__bin").agg(count, F.min("__x").alias("__lo"), F.max("__x").alias("__hi")), "bins")


def ranked_values(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]], weight: str | None = None,
                  bins: int = 128, counted: DataFrame | None = None) -> DataFrame:
    """``lo_<name>``, ``hi_<name>``: the values of a column beside a quantile per group, and ``n_<name>``, its values.

    ``wanted`` maps a name to (column, p); nulls are left out. ``df`` is read twice and should be stored. Values are
    counted by group and bin, which leaves little to shuffle; only the values of a bin that holds a wanted rank, and more
    than one value, are counted by themselves and ordered. The bins only save work; any bins give the same results.
    ``counted`` are the ``value_bins`` of the same rows and columns (as many or more, in this order) by these keys or more.
    """
    cols = list(dict.fromkeys(c for c, _ in wanted.values()))
    rows, count = _binned(df, keys, cols, weight, bins)
    group, at = [*keys, "__col"], [*keys, "__col", "__bin"]
    if counted is None:
        counted = value_bins(df, keys, cols, weight, bins)
    else:
        counted = counted.groupBy(*at).agg(
            F.sum("__n").alias("__n"), F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
    before = Window.partitionBy(*group).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumns({"__below": F.coalesce(F.sum("__n").over(before), F.lit(0)),
                                  "__total": F.sum("__n").over(Window.partitionBy(*group))})
    ranks = []
    for j, (c, p) in enumerate(wanted.values()):
        place = F.lit(float(p)) * (F.col("__total") - 1)
        ranks += [F.struct(F.lit(cols.index(c)).alias("__of"), F.lit(2 * j + side).alias("__j"), rank(place).alias("__rank"))
                  for side, rank in enumerate((F.floor, F.ceil))]
    hits = placed.select("*", F.inline(F.array(*ranks))).filter(
        (F.col("__of") == F.col("__col")) & (F.col("__below") <= F.col("__rank")) & (F.col("__rank") < F.col("__below") + F.col("__n")))
    hits = stage(hits.drop("__n", "__of"), "ranks")
    mixed = hits.filter("__lo <> __hi").drop("__lo", "__hi")
    inside = lookup(rows, mixed.select(*at).distinct(), at, "left_semi", null_safe=True)
    inside = stage(inside.groupBy(*at, "__x").agg(count), "values")
    ordered = running(inside, at, ["__x"], {"__before": ("sum", F.col("__n"))}, stored=True)
    start = F.col("__below") + F.col("__before")
    met = lookup(ordered, mixed, at, null_safe=True).filter(
        (start <= F.col("__rank")) & (F.col("__rank") < start + F.col("__n")))
    names = [*keys, "__j", "__total", "__x"]
    found = hits.filter("__lo = __hi").withColumnRenamed("__lo", "__x").select(*names).unionByName(met.select(*names))

    def of(j: int, name: str) -> Column:
        return F.max(F.when(F.col("__j") == j, F.col(name)))

    return found.groupBy(*keys).agg(*[c for j, name in enumerate(wanted) for c in (
        of(2 * j, "__x").alias(f"lo_{name}"), of(2 * j + 1, "__x").alias(f"hi_{name}"), of(2 * j, "__total").alias(f"n_{name}"))])


def column_medians(df: DataFrame, keys: list[str], cols: list[str], accuracy: int = 128,
                   counted: DataFrame | None = None) -> DataFrame:
    """Exact median of each column per group (linear between the middle two; nulls left out), one row per group.

    ``df`` is read twice and should be stored, once with ``counted``; ``accuracy`` is the number of bins of ``ranked_values``.
    """
    found = ranked_values(df, keys, {str(i): (c, 0.5) for i, c in enumerate(cols)}, bins=accuracy, counted=counted)
    return found.select(*keys, *[((F.col(f"lo_{i}") + F.col(f"hi_{i}")) / 2).alias(c) for i, c in enumerate(cols)])


def _picked_ranks(ordered: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    aggs = [F.max("total").alias("n")]
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("total") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("below") <= rank) & (rank < F.col("below") + F.col("n"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"__{side}_{name}"))
    return ordered.groupBy(*keys).agg(*aggs)


def percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                approx: bool = False, accuracy: int = 10000, maps: dict | None = None,
                weight: str | None = None, stored: bool = False) -> DataFrame:
    """Exact linear-interpolated percentiles per group (one row per group, plus the count ``n``).

    ``maps`` gives an increasing function for some of the names: the percentile of the mapped value, from one ordering.

    The built-in exact aggregate keeps all values of a group in one task; this selects the two needed ranks from
    counted, ordered values instead. ``stored`` rows are read twice instead, so that few values are ordered.
    ``approx=True`` uses the bounded-memory sketch.
    """
    if approx:
        maps = maps or {}
        picks = F.percentile_approx(value, list(probs.values()), F.lit(accuracy))
        sketch = df.groupBy(*keys).agg(F.count(value).alias("n"), picks.alias("__q"))
        return sketch.select(*keys, "n", *[
            maps.get(p, lambda c: c)(F.col("__q")[i]).alias(p) for i, p in enumerate(probs)])
    if stored:
        found = ranked_values(df, keys, {name: (value, p) for name, p in probs.items()}, weight)
        picked = found.select(*keys, F.col(f"n_{next(iter(probs))}").alias("n"), *[
            F.col(f"{side}_{name}").alias(f"__{side}_{name}") for name in probs for side in ("lo", "hi")])
    else:
        picked = _picked_ranks(ordered_values(df, keys, value, weight=weight), keys, value, probs)
    out = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("n") - 1)
        mapped = (maps or {}).get(name, lambda c: c)
        lo, hi = (mapped(F.col(f"__{side}_{name}").cast("double")) for side in ("lo", "hi"))
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return picked.select(*keys, "n", *out)
