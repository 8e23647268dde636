"""Two versions side by side: changed files, own text of symbols, pairing and kinds of change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hierarchy import holding

DECLARATION = ["signature", "decorators", "param_count", "is_varargs"]


def snapshot_diff(base: DataFrame, head: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status, old, new) of what was added, deleted or modified, with its values."""
    a, b = base.select(key, F.col(value).alias("__a"), F.lit(True).alias("__in_a")), head.select(key, F.col(value).alias("__b"), F.lit(True).alias("__in_b"))
    status = F.when(F.col("__in_a").isNull(), "added").when(F.col("__in_b").isNull(), "deleted").when(~F.col("__a").eqNullSafe(F.col("__b")), "modified")
    return a.join(b, key, "full_outer").select(key, status.alias("status"), F.col("__a").alias("old"), F.col("__b").alias("new")).where("status is not null")


def pair_versions(base: DataFrame, head: DataFrame, name: list[str], declaration: list[str], order: list[str]) -> DataFrame:
    """Old and new rows of one name, side by side: (name..., old struct, new struct).

    First the k-th old with the k-th new of one declaration, then what is left in order.
    """

    def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
        return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))

    same = [*name, *declaration]
    wrap = lambda rows, side: rows.select(*[F.col(c).alias(f"__{c}") for c in same], F.col("__k").alias("__n"), F.struct(*[c for c in rows.columns if c != "__k"]).alias(side))
    old, new = wrap(numbered(base, same), "old"), wrap(numbered(head, same), "new").withColumnsRenamed({f"__{c}": f"__r_{c}" for c in same} | {"__n": "__r_n"})
    on = (F.col("__n") == F.col("__r_n")) & F.lit(True)
    for c in same:
        on = on & F.col(f"__{c}").eqNullSafe(F.col(f"__r_{c}"))
    first = old.join(new, on, "full_outer").select("old", "new")
    left_old = numbered(first.where("new is null").select("old.*"), name).select(*[F.col(c) for c in name], F.col("__k"), F.struct(*base.columns).alias("old"))
    left_new = numbered(first.where("old is null").select("new.*"), name).select(*[F.col(c) for c in name], F.col("__k"), F.struct(*head.columns).alias("new"))
    second = left_old.join(left_new, [*name, "__k"], "full_outer").select("old", "new")
    return first.where("old is not null and new is not null").union(second)


def change_kind(declaration: list[str], text: str) -> Column:
    """removed, added, signature, body or null of a paired row (old, new)."""
    differ = F.lit(False)
    for c in declaration:
        differ = differ | ~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    return F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").when(differ, "signature").when(~F.col(f"old.{text}").eqNullSafe(F.col(f"new.{text}")), "body")


def own_spans(symbols: DataFrame) -> DataFrame:
    """(path, ordinal, kind, from, to): the lines of each symbol that lie in none of its children, as spans that don't overlap.

    The children of a symbol are swept in order of their start, with the farthest end before each.
    """
    inner = symbols.where("parent_ordinal is not null").select("path", F.col("parent_ordinal").alias("ordinal"), F.col("start_line").alias("a"), F.col("end_line").alias("b"))
    whole = symbols.select("path", "ordinal", "kind", F.col("start_line").alias("first"), F.col("end_line").alias("last"))
    before = Window.partitionBy("path", "ordinal").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    gaps = inner.withColumn("done", F.max("b").over(before)).join(whole, ["path", "ordinal"])
    gaps = gaps.select("path", "ordinal", "kind", F.greatest(F.col("done") + 1, "first").alias("from"), F.least(F.col("a") - 1, "last").alias("to"))
    tails = whole.join(inner.groupBy("path", "ordinal").agg(F.max("b").alias("done")), ["path", "ordinal"], "left")
    tails = tails.select("path", "ordinal", "kind", F.greatest(F.col("done") + 1, "first").alias("from"), F.col("last").alias("to"))
    return gaps.union(tails).where("from <= to")


def own_texts(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """(path, ordinal, own): a symbol's lines without its children's, all white space removed.

    lines: (path, line, text). Comment lines of types don't count. Lines meet the spans of their own symbols only, by path and bin.
    """
    bare = F.regexp_replace("text", r"(?U)\s+", "")
    own = holding(lines.select("path", "line", bare.alias("bare")), own_spans(symbols), ["path"], "line", "from", "to")
    comment = F.col("kind").isin("class", "interface", "enum", "record", "annotation") & F.col("bare").rlike(r"^(#|//|/\*|\*)")
    own = own.withColumn("bare", F.when(comment, "").otherwise(F.col("bare")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "bare"))), lambda x: x["bare"]), "")
    return symbols.select("path", "ordinal").join(own.groupBy("path", "ordinal").agg(text.alias("own")), ["path", "ordinal"], "left").fillna({"own": ""})
