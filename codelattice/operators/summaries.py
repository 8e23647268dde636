"""The counts behind answers: totals, languages, packages, kinds, tiers, files, and what imports or names what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def totals(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """(n_symbols, n_refs): one row."""
    one = lambda rows, a, b: rows.agg(a, b)
    none = F.lit(0).cast("bigint")
    both = one(symbols, F.count("*").alias("s"), none.alias("r")).unionByName(one(refs, none.alias("s"), F.count("*").alias("r")))
    return both.agg(F.sum("s").alias("n_symbols"), F.sum("r").alias("n_refs"))


def by_language(files: DataFrame) -> DataFrame:
    """(language, files, lines, tests, errors) of (path, language, line_count, has_errors)."""
    return files.groupBy("language").agg(
        F.count("*").alias("files"), F.sum("line_count").alias("lines"), F.count_if(X.is_test_path(F.col("path"))).alias("tests"), F.count_if("has_errors").alias("errors")
    )


def by_package(files: DataFrame, root: Column) -> DataFrame:
    """(package, files, lines, roots) of (package, line_count), the longest package first; roots are the distinct values of root, sorted."""
    rows = files.groupBy("package").agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"), F.array_sort(F.collect_set(root)).alias("roots"))
    return rows.orderBy(F.desc("lines"), "package")


def of_kind(symbols: DataFrame, kind: str | None) -> DataFrame:
    """Symbols of one kind, or all of them."""
    return symbols if kind is None else symbols.where(F.col("kind") == kind)


def by_kind(symbols: DataFrame, order: Column | None = None) -> DataFrame:
    """(kind, n), and the first place of each kind if an order is given."""
    first = [] if order is None else [F.min(order).alias("first")]
    return symbols.groupBy("kind").agg(F.count("*").alias("n"), *first)


def by_tier(refs: DataFrame, is_test: Column) -> DataFrame:
    """(n, files, tests, exact, likely, possible) of call sites (path, tier): one row."""
    tiers = [F.count_if(F.col("tier") == k).alias(name) for k, name in ((3, "exact"), (2, "likely"), (1, "possible"))]
    return refs.agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"), F.count_if(is_test).alias("tests"), *tiers)


def files_beyond(rows: DataFrame, key: list[str], order: list, shown: int, k: int) -> DataFrame:
    """(path, n): the k files with most rows among those that come after the first `shown` in order; ties by path."""
    first = rows.orderBy(*order).limit(shown).select(*key)
    return rows.join(first, key, "left_anti").groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(k)


def outside_imports(imports: DataFrame, k: int | None = None) -> DataFrame:
    """(name, n): what imports (language, module, dst) without a target in the index ask for, most often first."""
    rows = imports.where("dst is null").groupBy(X.external_name(F.col("module"), F.col("language")).alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name")
    return rows if k is None else rows.limit(k)


def importers_outside(imports: DataFrame, touched: DataFrame, changed: DataFrame) -> DataFrame:
    """Imports (path, dst, ...) of a touched module (dst) from files that are not among the changed ones (path)."""
    return imports.join(touched.select("dst").distinct(), "dst", "left_semi").join(changed.select("path").distinct(), "path", "left_anti")


def naming_imports(gone: DataFrame, imports: DataFrame) -> DataFrame:
    """Symbols (language, path, qualified_name, ...) with the imports that name them: `module.name`, or a static import of the symbol itself.

    imports: (path, language, ordinal, line, module, name, is_static). An import that names a symbol in both ways counts once.
    """
    i = imports.select(F.col("path").alias("i_path"), "language", F.col("ordinal").alias("i_ordinal"), F.col("line").alias("i_line"), "module", "name", "is_static")
    by_name = i.where("name is not null").withColumn("qualified_name", F.concat_ws(".", "module", "name"))
    by_module = i.where("is_static").withColumn("qualified_name", F.col("module"))
    both = by_name.unionByName(by_module).select("language", "qualified_name", "i_path", "i_ordinal", "i_line")
    return gone.join(both, ["language", "qualified_name"]).distinct()


def notice(hits: DataFrame, key: list[str]) -> DataFrame:
    """(key..., strong, weak) of call sites (tier, inside, change): sure ones outside the changed files (anywhere, of what was removed), and possible ones."""
    sure = (F.col("tier") >= 2) & (~F.col("inside") | (F.col("change") == "removed"))
    return hits.groupBy(*key).agg(F.count_if(sure).alias("strong"), F.count_if(F.col("tier") == 1).alias("weak"))


def best_of_each(rows: DataFrame, key: list) -> DataFrame:
    """(key..., tier): the best tier that any list gives each call site."""
    return rows.groupBy(*key).agg(F.max("tier").alias("tier"))


def within_lookups(changes: DataFrame, order: list, most: int) -> tuple[DataFrame, DataFrame]:
    """(changes that are looked up, changes beyond the first `most`), of (change, kind, ...): by kind of change, then by order.

    What was added has no callers and uses of fields aren't indexed: neither takes of the bound.
    """
    asked = changes.where("change <> 'added' and kind <> 'field'")
    rank = F.when(F.col("change") == "removed", 0).when(F.col("change") == "signature", 1).otherwise(2)
    first = asked.orderBy(rank, *order).limit(most)
    return first, asked.join(first.select(*order), order, "left_anti").select(*changes.columns)
