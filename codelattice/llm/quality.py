"""Quality rules: base counts, and divergence from language references.

A document's histogram of character classes and its histogram of common words are compared with
those of each language, summed over all documents that carry its label, by the Jensen-Shannon
distance (base 2, from 0 to 1). A document fails if, for every language, one of the two is farther
than its limit. Short texts vary more, so a histogram only counts above a least number of characters
or words, and its limit is wider the shorter the text. All of it is DataFrame expressions; the texts
are read once, into a table of counts, and the references hold one row for each language.

Which words are common is learnt from all labelled documents: the COMMON most frequent ones of each language, by a
count that combines before it shuffles. A document's histogram of them is sparse (the words that it has), so one pass over its
words and one over the references serve any number of languages.

Defined results: a null text has no words and fails the base rules; without any labelled document
there is no reference and the base rules decide alone; equal texts get equal verdicts; rows without a
label are judged like all others; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import SPACE, stored

#: Words of each language that are counted one by one.
COMMON = 20
#: Character classes, by what is counted; letters that are none of these are the rest of the words.
CLASSES = {
    "upper": r"\p{Lu}+",
    "digit": r"\p{N}+",
    "stop": r"[.,;:!?'\"()\-]+",
    "symbol": r"[#*$%&|<>@^~={}\[\]\\/_+`]+",
    "vowel": r"[aeiou]+",
}
LEAST_CHARS, LEAST_WORDS = 200, 100
#: Limits of the distance for long texts, and what is added for short ones: slack / sqrt(length).
CHAR_LIMIT, CHAR_SLACK = 0.20, 1.5
WORD_LIMIT, WORD_SLACK = 0.45, 2.5


def _array_at(a: Column, i: Column) -> Column:
    return F.get(a, i.cast("int"))


def repeat_words(words: Column, n: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    Window hashes are sorted together with their places, so equal ones are neighbours; each place covers up to
    the next one, three words at most.
    """
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(_array_at(words, i), _array_at(words, i + 1), _array_at(words, i + 2)))

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.aggregate(F.array(placed), F.lit(0), lambda acc, p: acc + _covered(p))

    held = F.aggregate(F.array(windows), F.lit(0), lambda acc, hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), acc).otherwise(covered(hs)))
    return F.when(n < 4, F.lit(0)).otherwise(held).cast("long")


def _covered(placed: Column) -> Column:
    same = lambda x, i: F.coalesce(x["h"] == _array_at(placed, i)["h"], F.lit(False))
    twice = F.filter(placed, lambda x, i: same(x, i - 1) | same(x, i + 1))
    places = F.sort_array(F.transform(twice, lambda x: x["i"]))
    return F.aggregate(
        F.array(places),
        F.lit(0),
        lambda acc, ps: acc + F.aggregate(F.transform(ps, lambda p, i: F.least(F.lit(3), F.coalesce(_array_at(ps, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b),
    )


def plain_words(text: Column) -> Column:
    """Runs of letters, lower-cased."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def common_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> list[str]:
    """The most frequent words of each language, each once, in the order of language and frequency."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    times = rows.select("lang", F.explode(plain_words(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    best = times.withColumn("place", place).where(F.col("place") <= COMMON).groupBy("word").agg(F.min(F.struct("lang", "place")).alias("at"))
    return [r["word"] for r in best.orderBy("at").collect()]  # COMMON words of a language at most


def sparse_counts(words: Column, words_of: list[str]) -> Column:
    """(i, k) of each of words_of that is among the sorted words: its place in words_of, and how often it comes."""
    number = F.map_from_arrays(F.array(*map(F.lit, words_of)), F.array(*map(F.lit, range(len(words_of)))))
    ends = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: ~_array_at(words, i).eqNullSafe(_array_at(words, i + 1)))
    runs = lambda e: F.transform(e, lambda x, j: F.struct(F.element_at(number, _array_at(words, x)).alias("i"), (x - F.coalesce(_array_at(e, j - 1), F.lit(-1))).cast("bigint").alias("k")))
    none = F.array().cast("array<struct<i:int,k:bigint>>")
    return F.when(F.size(words) == 0, none).otherwise(F.aggregate(F.array(ends), none, lambda acc, e: F.concat(acc, runs(e))))


def counts(docs: DataFrame, words_of: list[str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The base counts of each document, its label, and its two histograms."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = F.filter(F.split("text", rf"[{SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(rf"[^{SPACE}]"))
    without = lambda text, pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")
    # digits, stops and symbols are counted in what is left of a text without ASCII letters and white space, a small part of it
    rows = rows.select("*", F.regexp_replace("text", rf"[a-zA-Z{SPACE}]+", "").alias("marks"))
    rows = rows.select(
        "doc_id", "lang", "text", words.alias("words"), lines.alias("lines"), without("marks", r"[#*$%&|<>]+").alias("n_symbols"),
        plain_words(F.col("text")).alias("plain"),
        *[without("text" if c in ("upper", "vowel") else "marks", p).alias(f"c_{c}") for c, p in CLASSES.items()],
    )
    n = F.size("words")
    common = F.sort_array(F.filter("plain", lambda w: w.isin(*words_of))) if words_of else F.slice("plain", 1, 0)
    rows = rows.select("*", common.alias("common"))
    others = F.struct(F.lit(len(words_of)).alias("i"), (F.size("plain") - F.size("common")).cast("bigint").alias("k"))
    histogram = F.concat(sparse_counts(F.col("common"), words_of), F.array(others)) if words_of else F.array(others)
    word_chars = F.length(F.array_join("words", "")).cast("long")
    rest = word_chars - sum((F.col(f"c_{c}") for c in CLASSES), F.lit(0))
    return rows.select(
        "doc_id", "lang", n.cast("long").alias("n_words"), word_chars.alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words"), n).alias("n_repeat_words"),
        F.array(*[F.col(f"c_{c}") for c in CLASSES], F.greatest(rest, F.lit(0))).alias("chars"),
        F.size("plain").cast("long").alias("n_plain"), F.filter(histogram, lambda x: x["k"] > 0).alias("common"),
    )


def references(counted: DataFrame, n_words: int) -> list[tuple[str, list[float], list[float]]]:
    """(language, shares of character classes, shares of common words), over all labelled documents."""
    rows = counted.where("lang is not null")
    sums: dict[tuple[str, str], list[float]] = {}
    for kind, k, pairs in (("chars", len(CLASSES) + 1, F.posexplode("chars").alias("i", "k")), ("common", n_words + 1, F.inline("common"))):
        for r in rows.select("lang", pairs).groupBy("lang", "i").agg(F.sum("k").alias("k")).collect():  # as many rows as shares
            sums.setdefault((r["lang"], kind), [0.0] * k)[r["i"]] = float(r["k"])
    shares = {key: [v / sum(values) for v in values] for key, values in sums.items() if sum(values)}
    return [(lang, shares[lang, "chars"], shares[lang, "common"]) for lang in sorted({lang for lang, _ in shares}) if (lang, "chars") in shares and (lang, "common") in shares]


def _part(p: Column, q: Column) -> Column:
    return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))


def js_distance(histogram: Column, total: Column, reference) -> Column:
    """Jensen-Shannon distance, base 2, between a histogram's shares and reference shares (a list, or an array column)."""
    reference = reference if isinstance(reference, Column) else F.array(*map(F.lit, reference))
    terms = F.zip_with(histogram, reference, lambda k, q: _part(k / total, q) + _part(q, k / total))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2))


def sparse_js_distance(histogram: Column, total: Column, reference: Column) -> Column:
    """As js_distance(), of a histogram (i, k) without its zeros: what it lacks of the reference counts with its share."""

    def step(acc: Column, x: Column) -> Column:
        p, q = x["k"] / total, F.get(reference, x["i"])
        return F.struct((acc["s"] + _part(p, q) + _part(q, p)).alias("s"), (acc["left"] - q).alias("left"))

    start = F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("left"))
    return F.aggregate(histogram, start, step, lambda acc: F.sqrt(F.greatest(F.lit(0.0), (acc["s"] + F.greatest(acc["left"], F.lit(0.0))) / 2)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_words: int = 50) -> DataFrame:
    """One row per row of docs: the base counts, base_failed, kept, and the distances to the nearest language."""
    words_of = common_words(docs, text_col, lang_col)
    counted = stored(counts(docs, words_of, id_col, text_col, lang_col), "quality-counts")
    refs = references(counted, len(words_of))
    counted = counted.withColumn("n_chars", F.aggregate("chars", F.lit(0).cast("long"), lambda a, b: a + b))
    base = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))

    def verdict(ref: Column) -> Column:
        # over their limits by how much: at most 0 is fine
        a = F.when(F.col("n_chars") < LEAST_CHARS, 0.0).otherwise(F.round(js_distance(F.col("chars"), F.col("n_chars"), ref["chars"]), 6))
        b = F.when(F.col("n_plain") < LEAST_WORDS, 0.0).otherwise(F.round(sparse_js_distance(F.col("common"), F.col("n_plain"), ref["words"]), 6))
        pair = F.struct(a.alias("a"), b.alias("b"))
        over = lambda x: F.greatest(x["a"] - CHAR_LIMIT - CHAR_SLACK / F.sqrt(F.greatest("n_chars", F.lit(1))), x["b"] - WORD_LIMIT - WORD_SLACK / F.sqrt(F.greatest("n_plain", F.lit(1))))
        return F.get(F.transform(F.array(pair), lambda x: F.struct(over(x).alias("over"), x["a"].alias("char_distance"), x["b"].alias("word_distance"))), F.lit(0))

    numbers = lambda xs: "array(" + ", ".join(f"{x!r}D" for x in xs) + ")"
    table = F.expr("array(" + ", ".join(f"struct({numbers(c)} as chars, {numbers(w)} as words)" for _, c, w in refs) + ")")
    nearest = F.array_min(F.transform(table, verdict)) if refs else F.lit(None).cast("struct<over:double,char_distance:double,word_distance:double>")
    rows = counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), nearest.alias("near"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("near.over") <= 0, F.lit(True))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "near.char_distance", "near.word_distance")
