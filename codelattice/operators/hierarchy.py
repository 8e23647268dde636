"""Nested symbols and line intervals: ancestors, depth, innermost and outermost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..functions.text import CALLABLE_KINDS


def ancestors(nodes: DataFrame, key: list[str], parent: str, child: str) -> DataFrame:
    """(key..., child, ancestor, depth) of a forest; depth 1 is the parent. key names what trees don't cross.

    Each round doubles the depth that is known, so a chain of n takes log2(n) joins.
    """
    step = nodes.where(F.col(parent).isNotNull()).select(*key, F.col(child).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).cast("bigint").alias("depth"))
    known = step
    deepest = 1
    while True:
        far = known.where(F.col("depth") == deepest).withColumnsRenamed({"ancestor": "__via", "depth": "__far"})
        more = far.join(known.select(*key, F.col("node").alias("__via"), "ancestor", "depth"), [*key, "__via"])
        more = more.select(*key, "node", "ancestor", (F.col("depth") + F.col("__far")).alias("depth"))
        if not more.limit(1).count():
            return known
        known = cut(known.union(more))
        deepest *= 2


#: Lines of a bin: an interval is copied into the bins that it reaches, a point lies in one.
BIN = 128


def holding(points: DataFrame, intervals: DataFrame, key: list[str], at: str, start: str, end: str) -> DataFrame:
    """points joined to the intervals of their key that hold them, by equality on key and bin; the range is a residue."""
    whole = intervals.where(F.col(start) <= F.col(end))
    bins = whole.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / BIN), F.floor(F.col(end) / BIN))))
    hits = points.withColumn("__bin", F.floor(F.col(at) / BIN)).join(bins, [*key, "__bin"])
    return hits.where((F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end))).drop("__bin")


def innermost(points: DataFrame, intervals: DataFrame, key: list[str], at: str, start: str, end: str, order: list[Column], pick: str) -> DataFrame:
    """Each point with the interval of its key that holds it, starts last and is the shortest; null without one."""
    hits = holding(points, intervals, key, at, start, end).select(*points.columns, F.col(pick), F.struct(F.col(start), *order).alias("__o"))
    every = hits.unionByName(points, allowMissingColumns=True)  # so that points in no interval stay
    return every.groupBy(*points.columns).agg(F.max_by(pick, "__o").alias(pick))


def inside_any(points: DataFrame, intervals: DataFrame, key: list[str], at: str, start: str, end: str) -> DataFrame:
    """Points with `inside`: whether start < at <= end for any interval of the key."""
    hits = holding(points, intervals, key, at, start, end).where(F.col(start) < F.col(at)).select(*points.columns).withColumn("inside", F.lit(True))
    return hits.unionByName(points, allowMissingColumns=True).groupBy(*points.columns).agg(F.coalesce(F.max("inside"), F.lit(False)).alias("inside"))


def around(symbols: DataFrame, *columns: str) -> DataFrame:
    """(path, node, ancestor, depth, columns of the ancestor) for each symbol and all that it lies in, itself (depth 0) included.

    symbols have labels: ancestry is a range test, joined by path and bin of ordinals; there is no loop over levels.
    """
    nodes = symbols.select("path", F.col("ordinal").alias("node"), F.col("depth").alias("__node_depth"))
    spans = symbols.select("path", F.col("ordinal").alias("ancestor"), "last_ordinal", F.col("depth").alias("__depth"), *columns)
    found = holding(nodes, spans, ["path"], "node", "ancestor", "last_ordinal")
    return found.select("path", "node", "ancestor", (F.col("__node_depth") - F.col("__depth")).cast("bigint").alias("depth"), *columns)


def outermost_callables(symbols: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """Callables without a callable above them.

    Symbols with labels need one window: a callable lies in another if one that begins before it reaches as far. For others, closure
    is ancestors() of symbols by path and ordinal.
    """
    calls = symbols.where(F.col("kind").isin(*CALLABLE_KINDS))
    if closure is None:
        before = Window.partitionBy("path").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
        reach = calls.withColumn("__reach", F.max("last_ordinal").over(before))
        return reach.where(F.col("__reach").isNull() | (F.col("__reach") < F.col("ordinal"))).drop("__reach")
    above = closure.join(calls.select("path", F.col("ordinal").alias("ancestor")), ["path", "ancestor"], "left_semi")
    return calls.join(above.select("path", F.col("node").alias("ordinal")), ["path", "ordinal"], "left_anti")
