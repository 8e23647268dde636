"""Mixing sources to target weights by entropy balancing.

Every document gets a rate between 0 and 2 copies. Among all rates whose expected words meet each
source's target, the ones closest in (bounded) entropy to one copy each are exponentially tilted:
rate = 2 / (1 + exp(-l * size / mean size)), with one multiplier l per source. The multipliers are
the optimum of a convex dual; distributed Newton steps, kept inside a shrinking bracket, find them
from a histogram (source, size, documents), so that a step never touches the documents again.
Rates are then rounded into whole copies: documents of one source are dealt into buckets by a hash,
sorted by size within each, and the running sum of rates is rounded, so that neighbours of almost
equal size make up for each other.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a
document of size 0 takes nothing; repeated rows count each on their own; an empty table gives an
empty one. Columns beside the named ones are never looked at, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import count_words, cut

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Documents of one source that are rounded together.
BUCKET_ROWS = 1024
#: Sources whose multipliers are broadcast at most (some 10 MB); with more, rows are dealt anew by source and bucket.
BROADCAST_SOURCES = 100_000
#: Units of a rate, so that running sums are exact.
UNIT = 1 << 30


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source key: (k, source_size, docs, target); sizes has (k, size, docs).

    Targets stop at `most` times a source's size and the excess goes to the others by weight. With
    sources in the order of (limit / weight), the common level follows from running sums. The
    windows see one row per source.
    """
    per = sizes.groupBy("k").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"), F.sum("docs").alias("docs"))
    place = F.row_number().over(Window.orderBy("k")) - 1
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights)) + 1))
    per = per.withColumn("limit", F.col("source_size") * F.lit(most))
    whole = Window.partitionBy(F.lit(0))
    order = Window.orderBy(F.col("limit") / F.col("w"), "k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    per = per.withColumn("level", level)
    open_ = F.col("level") <= F.col("limit") / F.col("w")
    per = per.withColumn("at", F.min(F.when(open_, F.struct(F.col("limit") / F.col("w"), "k", "level"))).over(whole)["level"])
    target = F.least(F.col("limit"), F.coalesce(F.col("at") * F.col("w"), F.col("limit")))
    return per.select("k", "source_size", "docs", target.alias("target"))


def _rate(tilt: Column, size: Column, mean: Column, most: float) -> Column:
    return F.lit(most) / (F.lit(1.0) + F.exp(F.least(F.lit(700.0), -tilt * size / mean)))


def balance(sizes: DataFrame, targets: DataFrame, most: float = MOST, steps: int = 60, tolerance: float = 1e-7) -> DataFrame:
    """Targets with the multiplier `tilt` of each source: (k, source_size, docs, target, mean, tilt).

    tilt is null where every rate is fixed: 0 for a target of 0, `most` for a target at the limit.
    """
    mean = F.col("source_size") / F.col("docs")
    fixed = (F.col("target") >= F.col("source_size") * F.lit(most * (1 - 1e-12))) | (F.col("target") <= 0)
    state = targets.withColumn("mean", mean).withColumn("tilt", F.when(~fixed, F.lit(0.0)))
    state = state.withColumns({"low": F.lit(-1.0), "high": F.lit(1.0), "shut_low": F.lit(False), "shut_high": F.lit(False), "off": F.when(fixed, 0.0).otherwise(1.0)})
    state = cut(state)
    for _ in range(steps):
        open_ = state.where(F.col("tilt").isNotNull() & (F.col("off") > tolerance))
        rate = _rate(F.col("tilt"), F.col("size"), F.col("mean"), most)
        at = (
            sizes.join(open_.select("k", "tilt", "mean"), "k")
            .groupBy("k")
            .agg(
                F.sum(F.col("docs") * F.col("size") * rate).alias("got"),
                F.sum(F.col("docs") * F.col("size") * F.col("size") / F.col("mean") * rate * (1 - rate / F.lit(most))).alias("slope"),
            )
        )
        gap = F.col("got") - F.col("target")
        moved = state.join(at, "k", "left").withColumns(
            {
                "off": F.when(F.col("got").isNull(), F.col("off")).otherwise(F.abs(gap) / F.col("target")),
                "low": F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")),
                "high": F.when(gap > 0, F.col("tilt")).otherwise(F.col("high")),
                "shut_low": F.col("shut_low") | F.coalesce(gap < 0, F.lit(False)),
                "shut_high": F.col("shut_high") | F.coalesce(gap > 0, F.lit(False)),
                "newton": F.when(F.col("slope") > 0, F.col("tilt") - gap / F.col("slope")),
            }
        )
        both = F.col("shut_low") & F.col("shut_high")
        half = F.when(both, (F.col("low") + F.col("high")) / 2).when(F.col("shut_low"), 2 * F.greatest(F.col("tilt"), F.lit(0.5))).otherwise(2 * F.least(F.col("tilt"), F.lit(-0.5)))
        inside = F.when(both, (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))).otherwise(F.abs(F.col("newton") - F.col("tilt")) <= 2 * F.abs(F.col("tilt")) + 1)
        move = F.col("got").isNotNull() & (F.col("off") > tolerance)
        state = cut(moved.withColumn("tilt", F.when(~move, F.col("tilt")).when(F.coalesce(inside, F.lit(False)), F.col("newton")).otherwise(half)).drop("got", "slope", "newton"))
        if not state.where(F.col("off") > tolerance).limit(1).count():
            break
    else:
        if state.where(F.col("off") > 1e-4).limit(1).count():
            raise ArithmeticError(f"a source is off its target after {steps} steps")
    return state.select("k", "source_size", "docs", "target", "mean", F.round("tilt", 9).alias("tilt"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, carry: bool = False) -> DataFrame:
    """One row per document: (doc_id, source, size, source_size, target, rate, copies, taken).

    With carry, the document's own columns follow instead, as one struct `doc`, beside `copies`.
    """
    key = F.when(F.col(source_col).isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), F.col(source_col)))
    words = F.coalesce(count_words(F.col(text_col)), F.lit(0)).cast("long")
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if carry else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), key.alias("k"), words.alias("size"), F.xxhash64(F.col(text_col)).alias("tie"), *whole)
    sizes = cut(rows.groupBy("k", "size").agg(F.count("*").alias("docs")))
    state = cut(balance(sizes, source_targets(sizes, weights, share, most), most))
    rate = F.when(F.col("target") <= 0, 0.0).when(F.col("tilt").isNull(), F.lit(most)).otherwise(_rate(F.col("tilt"), F.col("size"), F.col("mean"), most))
    few = state.count() <= BROADCAST_SOURCES
    rows = rows.join(F.broadcast(state) if few else state, "k").withColumn("units", F.round(rate * UNIT).cast("long"))
    spread = F.xxhash64(F.col("doc_id"), F.col("size"), F.col("tie"))
    rows = rows.withColumn("bucket", F.pmod(spread, F.ceil(F.col("docs") / BUCKET_ROWS)))
    rows = rows if few else rows.repartition("k", "bucket")
    run = Window.partitionBy("k", "bucket").orderBy(F.desc("size"), spread, "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sum", F.sum("units").over(run))
    rounded = lambda c: F.shiftright(c + UNIT // 2, 30)
    rows = rows.withColumn("copies", rounded(F.col("sum")) - rounded(F.col("sum") - F.col("units")))
    if carry:
        return rows.select("doc", "copies")
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("units") / UNIT).alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"))
