"""Word search: postings, BM25 over prefixes, exact names, the merge of exact hits with word hits, and close names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dotted_suffix, tokens
from .ranking import top_per_group

K1, B = 1.2, 0.75
#: Edits between two names that are close.
EDITS = 2


def postings(docs: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key..., term, tf, len): one row per term and document; len counts all tokens of the document."""
    rows = docs.select(*key, tokens(F.col(text)).alias("__t"))
    rows = rows.select(*key, F.size("__t").cast("bigint").alias("len"), F.explode("__t").alias("term"))
    return rows.groupBy(*key, "len", "term").agg(F.count("*").alias("tf"))


def bm25_prefix(posts: DataFrame, sizes: DataFrame | tuple[int, int], key: list[str], prefixes: list[str]) -> DataFrame:
    """(key..., score): documents with a token for each prefix; lower is better.

    sizes: (key..., len) of all documents, with those without a token, or their number and the sum of their lengths. Statistics
    are over all of them; filters belong after this step. Of postings that are stored in the order of their terms, only the row
    groups of the prefixes are read.
    """
    known = isinstance(sizes, tuple)
    total = None if known else sizes.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    hits = None
    for i, prefix in enumerate(prefixes):
        own = posts.where(F.startswith("term", F.lit(prefix))).groupBy(*key, "len").agg(F.sum("tf").alias("f"))
        own = own.withColumn("term_no", F.lit(i))
        hits = own if hits is None else hits.unionByName(own)
    seen = hits.groupBy("term_no").agg(F.count("*").alias("n"))  # a row per prefix
    rows = hits.join(F.broadcast(seen), "term_no")
    if known:
        rows = rows.withColumns({"n_docs": F.lit(sizes[0]), "avg_len": F.lit(sizes[1] / max(1, sizes[0]))})
    else:
        rows = rows.join(F.broadcast(total))  # one row
    idf = F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return rows.groupBy(*key).agg(F.count("*").alias("n_terms"), F.sum(part).alias("__s")).where(F.col("n_terms") == len(prefixes)).select(*key, (-F.col("__s")).alias("score"))


def tiered_merge(exact: DataFrame, words: DataFrame, key: list[str]) -> DataFrame:
    """Exact hits (tier 0), then word hits that aren't among them (tier 1)."""
    rest = words.join(exact.select(*key), key, "left_anti").withColumn("tier", F.lit(1))
    return exact.withColumn("tier", F.lit(0)).unionByName(rest)


def exact(symbols: DataFrame, query: str) -> DataFrame:
    """Symbols (name, qualified_name, ...) called query: by name, or by the end of the dotted name if the query is dotted."""
    return symbols.where(dotted_suffix(F.col("qualified_name"), query) if "." in query else F.col("name") == query)


def _without(texts: Column, edits: int) -> Column:
    """The texts of an array, and what is left of each without up to `edits` of its characters."""
    if not edits:
        return texts
    none = F.array().cast("array<string>")
    one = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    less = F.flatten(F.transform(texts, lambda x: F.when(F.length(x) > 0, one(x)).otherwise(none)))
    return F.array_distinct(F.concat(texts, _without(F.array_distinct(less), edits - 1)))


def _deletions(name: Column, edits: int) -> Column:
    """Hashes of a name without up to `edits` of its characters; names within so many edits have one in common."""
    return F.array_distinct(F.transform(_without(F.array(name), edits), lambda x: F.xxhash64(x)))


def close_names(asked: DataFrame, known: DataFrame, edits: int = EDITS) -> DataFrame:
    """(word, name, distance): the distinct names (column name) within so many edits of the distinct words (column word); an edit is a character put in, left out or replaced.

    Candidates share a deletion, so nothing is compared all with all; names of one length each give about l^edits / edits of them.
    Null words and names take no part; equal ones have a distance of 0.
    """
    spread = lambda rows, c: rows.select(c).where(F.col(c).isNotNull()).distinct().select(c, F.explode(_deletions(F.col(c), edits)).alias("__d"))
    pairs = spread(asked, "word").join(spread(known, "name"), "__d").where(F.abs(F.length("word") - F.length("name")) <= edits).select("word", "name").distinct()
    return pairs.withColumn("distance", F.levenshtein("word", "name", edits)).where("distance >= 0")


def closest(asked: DataFrame, known: DataFrame, k: int, edits: int = EDITS) -> DataFrame:
    """(word, name, distance, place): of each word the k closest names; ties by name."""
    return top_per_group(close_names(asked, known, edits), ["word"], ["distance", "name"], k)
