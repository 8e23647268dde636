"""Document fingerprints by Order MinHash.

The k-mers of a text are its windows of K words (fewer words: the whole text is one). Each is numbered by its
occurrence, so repeats count, and hashed with that number. The leading bits of the hash deal the
k-mers into BINS; in each bin the two least hashes are kept (of a bin with one k-mer: it and the least hash of
the next bin in use, going around), put back into the order in which their k-mers stand
in the text, and hashed as a pair. A pair changes when one of its k-mers is edited and also when the two
change places, so the share of equal pairs follows the edit distance rather than the set overlap, also in
texts of a few words. One permutation with bins serves in place of BINS permutations; bins that are empty in
both texts don't count. All of it is DataFrame expressions inside one row, linear in the text but for the sorts.

The next document in descending order of id is found without a global sort: ids are dealt into
ranges by approximate quantiles, texts are shuffled once by range, and each range also gets the
first document of the range below, so that a window inside the range sees every neighbour.

Defined results: a null text is empty; a text without a word has an empty fingerprint, which is like
another empty one (1.0) and unlike all others (0.0); rows with one id follow each other in the order of
their text's hash; rows without id come last; one document alone is its own next one; a text of K words or
fewer has one k-mer, which is its own pair; places of k-mers count modulo 2**PLACE_BITS; an empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import SPACE

K = 3
BINS_LOG = 6
PLACE_BITS = 26
PAIR_BITS = 18


def _at(a: Column, i: Column) -> Column:
    return F.get(a, i.cast("int"))


def _call(name: str, *args) -> Column:
    return F.call_function(name, *[a if isinstance(a, Column) else F.lit(a) for a in args])


def _bind(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _kmers(text: Column) -> Column:
    """Hashes of the k-mers of a text, in text order."""

    def of(words: Column) -> Column:
        n = F.size(words)
        windows = F.transform(F.sequence(F.lit(0), n - K), lambda i: F.xxhash64(*[_at(words, i + j) for j in range(K)]))
        few = F.transform(F.filter(F.array(F.array_join(words, " ")), lambda w: w != ""), lambda w: F.xxhash64(w, F.lit(K)))
        return F.when(n >= K, windows).otherwise(few)

    return _bind(F.filter(F.split(text, rf"[{SPACE}]+"), lambda w: w != ""), of)


def _numbered(hashes: Column) -> Column:
    """For each k-mer: leading bits of the hash of (k-mer, occurrence), and its place in the low bits; sorted."""
    low, high = (1 << PLACE_BITS) - 1, -(1 << PLACE_BITS)
    name = lambda x: x.bitwiseAND(F.lit(high))
    value = lambda x, number: F.xxhash64(name(x), number).bitwiseAND(F.lit(high)).bitwiseOR(x.bitwiseAND(F.lit(low)))

    def of(packed: Column) -> Column:
        def by_run(starts: Column) -> Column:
            def one(start: Column, q: Column) -> Column:
                run = F.slice(packed, start + 1, F.coalesce(_at(starts, q + 1), F.size(packed)) - start)
                return F.transform(run, lambda x, number: value(x, number))

            once = F.transform(packed, lambda x: value(x, F.lit(0)))
            return F.when(F.size(starts) == F.size(packed), once).otherwise(F.flatten(F.transform(starts, one)))

        firsts = F.filter(F.sequence(F.lit(0), F.size(packed) - 1), lambda i: ~F.coalesce(name(_at(packed, i)) == name(_at(packed, i - 1)), F.lit(False)))
        return F.when(F.size(packed) == 0, packed).otherwise(_bind(firsts, by_run))

    packed = F.sort_array(F.transform(hashes, lambda h, i: name(h).bitwiseOR(i.cast("long").bitwiseAND(F.lit(low)))))
    return F.sort_array(_bind(packed, of))


def order_minhash(text: Column) -> Column:
    """The fingerprint as an array of integers, one for each bin in use: bin, then the pair's hash."""
    bin_ = lambda x: _call("shiftrightunsigned", x, 64 - BINS_LOG)
    place = lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    name = lambda x: x.bitwiseAND(F.lit(-(1 << PLACE_BITS)))

    def of(values: Column) -> Column:
        least = F.filter(values, lambda x, i: ~F.coalesce(bin_(x) == bin_(_at(values, i - 2)), F.lit(False)))
        return _bind(least, pairs)

    def pairs(least: Column) -> Column:
        def pair(x: Column, i: Column) -> Column:
            y = F.coalesce(_at(least, i + 1), F.when(F.size(least) > 1, _at(least, F.lit(0))))
            first_first = F.coalesce(place(x) < place(y), F.lit(True))
            tuple_ = F.when(first_first, F.xxhash64(name(x), name(y))).otherwise(F.xxhash64(name(y), name(x)))
            head = ~F.coalesce(bin_(x) == bin_(_at(least, i - 1)), F.lit(False))
            return F.when(head, _call("shiftleft", bin_(x), PAIR_BITS).bitwiseOR(tuple_.bitwiseAND(F.lit((1 << PAIR_BITS) - 1))).cast("int"))

        return F.filter(F.transform(least, pair), lambda x: x.isNotNull())

    return _bind(_numbered(_kmers(text)), of)


def as_text(entries: Column) -> Column:
    return F.array_join(F.transform(entries, lambda x: F.lpad(F.lower(F.hex(x.cast("long"))), 6, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Equal pairs among the bins that either fingerprint uses."""
    bins = lambda x: F.transform(x, lambda e: _call("shiftrightunsigned", e, PAIR_BITS))
    used = F.size(F.array_union(bins(a), bins(b)))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.round(F.size(F.array_intersect(a, b)) / used, 6))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds lie below key: first among every n-th bound, then between two of these. Either list is one literal of the plan."""
    if not bounds:
        return F.lit(0)
    numbers = lambda x: F.split(F.lit(",".join(map(str, x))), ",").cast("array<bigint>")
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.size(F.filter(numbers(bounds[step - 1 :: step]), lambda b: b < key))
    fine = F.slice(numbers(bounds), coarse * step + 1, F.lit(step))
    return coarse * step + F.size(F.filter(fine, lambda b: b < key))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    least_id = -(1 << 63)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(least_id)))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], max(10_000, 20 * ranges)).alias("b")).first()["b"] or []
    bounds = sorted(set(bounds))
    rows = rows.withColumn("range", _range_of(F.col("key"), bounds).cast("int"))
    tie = F.xxhash64("text")
    tops = [(r["range"], r["key"]) for r in rows.groupBy("range").agg(F.max("key").alias("key")).orderBy(F.desc("range")).collect()]  # `ranges` rows at most
    before = {b: a for (a, _), (b, _) in zip(tops, tops[1:] + tops[:1])}  # the range that ends where b begins
    tops = spark.createDataFrame([(*t, before[t[0]]) for t in tops], "range int, key bigint, host int")
    guests = rows.join(F.broadcast(tops), ["range", "key"]).groupBy("host").agg(F.min(F.struct(tie.alias("t"), "text")).alias("top"))
    guests = guests.select(F.lit(None).cast("long").alias("doc_id"), F.col("top.text").alias("text"), F.lit(None).cast("long").alias("key"), F.col("host").alias("range"), F.lit(1).alias("guest"))
    every = rows.withColumn("guest", F.lit(0)).unionByName(guests).withColumn("marks", order_minhash(F.col("text")))
    order = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("key"), tie, "text")
    every = every.withColumn("next", F.lead(F.struct("text", "marks")).over(order)).where("guest = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    every = every.select("doc_id", n.cast("long").alias("n_chars"), "marks", F.col("next.marks").alias("next_marks"), edited.alias("edited"))
    every = every.select("*", order_minhash(F.col("edited")).alias("edited_marks"))
    return every.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("marks")).alias("fingerprint"),
        as_text(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"),
        likeness(F.col("marks"), F.col("next_marks")).alias("near_next"),
    )
