"""Rankings and cuts: repeats, best tiers, top-k, and prefixes that fit a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

CHARS_PER_TOKEN, HEADROOM = 3, 560


def repeats(rows: DataFrame, caller: list, order: list) -> DataFrame:
    """rows with `repeat`: how many rows of the same caller come before."""
    return rows.withColumn("repeat", (F.row_number().over(Window.partitionBy(*caller).orderBy(*order)) - 1).cast("bigint"))


def best_tier(rows: DataFrame, ref: list[str], tier: str = "tier") -> DataFrame:
    """Of each reference, all candidates of the highest tier; a null tier excludes a candidate."""
    rows = rows.where(F.col(tier).isNotNull())
    return rows.withColumn("__best", F.max(tier).over(Window.partitionBy(*ref))).where(F.col(tier) == F.col("__best")).drop("__best")


def top_per_group(rows: DataFrame, group: list, order: list, k: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= k)


def budget(cap_tokens: int, head_chars: int = 0) -> int:
    return cap_tokens * CHARS_PER_TOKEN - HEADROOM - head_chars


def running_sum(rows: DataFrame, value: str, order: list, out: str, most: int | None = None) -> DataFrame:
    """rows with `out`, the sum of value over all rows up to each in order; no task sees more than a range of rows.

    Rows are dealt into ranges of the order, ranges add up on their own, and what comes before each range is the sum
    of the ranges before it: one number a range goes to the driver. With most, ranges that begin beyond it are left out.
    """
    dealt = cut(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sums = dealt.groupBy("__range").agg(F.sum(value).alias("s")).orderBy("__range").collect()  # a row a range
    before, total = {}, 0
    for r in sums:
        if most is None or total <= most:
            before[r["__range"]] = total
        total += r["s"] or 0
    if not before:
        return dealt.withColumn(out, F.lit(None).cast("bigint")).drop("__range").limit(0)
    start = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("__range"))
    inside = F.sum(value).over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.where(F.col("__range").isin(*before)).withColumn(out, inside + start).drop("__range")


def prefix_within(rows: DataFrame, text: str, order: list, chars: int, group: list | None = None) -> DataFrame:
    """The longest ranked prefix whose lines, with their breaks, fit into chars (in each group)."""
    rows = rows.withColumn("__cost", F.length(text) + 1)
    if group is None:
        rows = running_sum(rows, "__cost", order, "used", chars)
    else:
        rows = rows.withColumn("used", F.sum("__cost").over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where(F.col("used") <= chars).drop("__cost")


def grouped_prefix_within(rows: DataFrame, text: str, header: str, order: list, chars: int, partition: list | None = None, under: int = 0) -> DataFrame:
    """As prefix_within(), but a line costs 3 more and the first line of a header costs its header too, without the first `under` characters that all headers share."""
    first = F.row_number().over(Window.partitionBy(*(partition or []), header).orderBy(*order)) == 1
    rows = rows.withColumn("cost", F.length(text) + 3 + F.when(first, F.length(header) + 1 - under).otherwise(0))
    if partition is None:
        rows = running_sum(rows, "cost", order, "used", chars)
    else:
        rows = rows.withColumn("used", F.sum("cost").over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where(F.col("used") <= chars)


#: What rank_of_caller() orders by.
CALLER_ORDER = ["tier", "is_test", "repeat", "line", "col"]


def caller_order() -> list:
    return [F.desc("tier"), "is_test", F.col("repeat") > 0, "path", "line", "col"]


def rank_of_caller(rows: DataFrame, caller: list, is_test: Column) -> DataFrame:
    """References (tier, path, line, col) in order: best tier, tests last, a caller's first site before its repeats, then by place."""
    return repeats(rows.withColumn("is_test", is_test), caller, ["line", "col"]).orderBy(*caller_order())


def common_directory(rows: DataFrame, group: list[str], path: str) -> DataFrame:
    """The directories that all paths of a group share, if they are two at least and so are the paths; else ''."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    ends = rows.groupBy(*group).agg(F.min(dirs).alias("a"), F.max(dirs).alias("b"), F.min(path).alias("x"), F.max(path).alias("y"))
    differ = F.filter(F.transform(F.zip_with("a", "b", lambda p, q: ~p.eqNullSafe(q)), lambda d, i: F.when(d, i)), lambda i: i.isNotNull())
    shared = F.slice("a", F.lit(1), F.coalesce(F.array_min(differ), F.size("a")))
    text = F.when((F.size(shared) >= 2) & (F.col("x") != F.col("y")), F.array_join(shared, "/")).otherwise("")
    return ends.select(*group, text.alias("common_dir"))


def impact_group(change: Column, strong: Column) -> Column:
    """Order of changes: removed or re-declared with strong callers, body with them, the same two without, added last."""
    declared = change.isin("removed", "signature")
    return F.when(change == "added", 4).when(declared, F.when(strong > 0, 0).otherwise(2)).otherwise(F.when(strong > 0, 1).otherwise(3))
