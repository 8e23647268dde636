"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

Two small collections of minhash groups are computed for each distinct shingle set. The key of table
(i, j) combines group i of the first collection with group j of the second, so 2 * m groups serve
m * m tables. Two sets at a similarity s meet in some table with probability
(1 - (1 - s**g)**m)**2. With g = 2, the least m that misses at most MISSED of the pairs at the threshold
is 8 at 0.85 (0.99993, and 0.999997 at 0.9) and 10 at 0.8 (0.99993).

Equal sets become one class first, so that copies never meet each other again. In each table bucket a
class is compared with the bucket's smallest one. Of the buckets whose other classes are then not yet one
component, every pair that still lies in two components and can be a link is compared on full sets, in parts of
bounded size, so all pairs that share a table are settled, and no bucket has a limit. A group beyond one part
first loses the rows that share none of their rarest shingles with another component, which rules links out. What then
still falls into several components costs comparisons with its square, and as many copies of a row as it
fills blocks of PART_SHINGLES. All aggregates combine before they shuffle; joins on hot keys are left to
adaptive skew splitting.

In the comparisons with smallest classes, an odd sketch (the parity of the shingles that fall on each of
ODD_BITS bits) comes before full sets: it differs in no more bits than the sets have shingles of their own,
so a pair is left out only if it surely isn't alike enough.

Words and shingles are told apart by 64-bit hashes under a key out of all texts of the table (corpus_key), so that
nobody can write texts that collide without knowing the rest of the table; whole sets by two sums over
independent ones (128 bits). Links are confirmed under another seed than the one that made their candidates. Two given sets
of 10,000 shingles meet a false equal shingle with a probability of 5e-12, and one hardly moves a link.

Defined results: null, empty or blank texts have no shingles and are linked with nothing; rows are told
apart by id and text, so an id with two texts is two documents; rows without an id are linked with
nothing and have a null component; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .frames import corpus_key, cut, drop_stored, map_batches, stored
from .words import mix, pieces, shingles, word_hashes

IN_GROUP = 2
#: Most pairs, as a share of those at the threshold, that may meet in no table.
MISSED = 1e-4
ODD_BITS = 2048
#: Shingles of a block of rows that are compared in one task.
PART_SHINGLES = 250_000
#: Ids that are broadcast at most (8 MB); beyond that, the texts are joined by a shuffle.
BROADCAST_IDS = 500_000


def groups_for(percent: int) -> int:
    """The least number of groups of each collection with which pairs at the threshold meet."""
    m = 1
    while 1 - (1 - (1 - (percent / 100) ** IN_GROUP) ** m) ** 2 > MISSED:
        m += 1
    return m


def _factors(n: int) -> np.ndarray:
    rng = np.random.RandomState(77)
    return ((rng.randint(0, 1 << 32, n).astype(np.uint64) << np.uint64(32)) | rng.randint(0, 1 << 32, n).astype(np.uint64)) | np.uint64(1)


def _sets(text: pa.Array, k: int, lower: bool, seeds: tuple[int, ...]) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
    """Pieces of documents with their distinct shingles, sorted: (first, end, hashes by one or two seeds, places)."""
    twice = len(seeds) > 1
    for at, to, data, offsets in pieces(text):
        found = []
        for seed in seeds:
            h, _, _, firsts = word_hashes(data, offsets, lower, seed)
            values, places = shingles(h, firsts, k)
            found.append(values)
        values = found[0]
        order = np.arange(len(values)) if twice else None
        for d in np.flatnonzero(np.diff(places) > 1):
            own = slice(places[d], places[d + 1])
            if twice:
                order[own] = places[d] + np.argsort(values[own])
            else:
                values[own].sort()
        if twice:
            found = [x[order] for x in found]
            values = found[0]
        new = np.ones(len(values), bool)
        if len(values):
            new[1:] = values[1:] != values[:-1]
            new[places[:-1][np.diff(places) > 0]] = True
        sums = np.concatenate([[0], np.cumsum(new)])
        yield at, to, [x[new] for x in found], sums[places]


def _sums(values: np.ndarray, places: np.ndarray, how) -> np.ndarray:
    out = np.zeros(len(places) - 1, np.uint64)
    full = np.diff(places) > 0
    if full.any():
        out[full] = how.reduceat(values, places[:-1][full])
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, groups: int, seeds: tuple[int, int], lower: bool = True) -> DataFrame:
    """(doc_id, tie, n_shingles, set_a, set_b, sig): tie is a hash of the text, sig holds the 2 * groups group hashes."""
    n = 2 * groups * IN_GROUP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _factors(n)
        for batch in batches:
            for at, to, (values, others), places in _sets(batch.column(1), k, lower, seeds):
                least = np.zeros((to - at, n), np.uint64)
                for j in range(n):
                    least[:, j] = _sums((values ^ by[j]) * by[n - 1 - j], places, np.minimum)
                of = least[:, ::IN_GROUP].copy()
                for j in range(1, IN_GROUP):
                    of = mix(of) + least[:, j::IN_GROUP]
                flat = mix(of).view(np.int64).reshape(-1)
                sig = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 2 * groups, dtype=np.int32)), pa.array(flat))
                sums = [_sums(mix(x ^ salt), places, np.add).view(np.int64) for x, salt in zip((values, others), by)]
                own = [batch.column(c).slice(at, to - at) for c in (0, 2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(places)), *map(pa.array, sums), sig], ["doc_id", "tie", "n_shingles", "set_a", "set_b", "sig"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("tie"))
    return map_batches(rows, run, "doc_id bigint, tie bigint, n_shingles bigint, set_a bigint, set_b bigint, sig array<bigint>")


def shingle_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, k: int, seed: int, lower: bool = True) -> DataFrame:
    """(node, n, odd, set) for the documents (doc_id, tie) of ids, each once; odd is the set's odd sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, (values,), places in _sets(batch.column(1), k, lower, (seed,)):
                sets = pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(values.view(np.int64)))
                bit = (mix(values) >> np.uint64(16)) % np.uint64(ODD_BITS)
                own = np.repeat(np.arange(to - at, dtype=np.int64), np.diff(places)) * ODD_BITS
                odd = np.packbits((np.bincount(own + bit.astype(np.int64), minlength=(to - at) * ODD_BITS) & 1).astype(np.uint8)).view(np.int64)
                odd = pa.ListArray.from_arrays(pa.array(np.arange(0, len(odd) + 1, ODD_BITS // 64, dtype=np.int32)), pa.array(odd))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(np.diff(places)), odd, sets], ["node", "n", "odd", "set"])

    asked = ids.count()
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tie"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(ids) if asked <= BROADCAST_IDS else ids, ["doc_id", "tie"]).select("node", "text")
    sets = stored(map_batches(rows, run, "node bigint, n bigint, odd array<bigint>, set array<bigint>"), "sets")
    if sets.count() == asked:
        return sets
    once = stored(sets.dropDuplicates(["node"]), "sets")  # some of these rows stand in the table more than once
    drop_stored(sets)
    return once


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of edges (a, b): label is the smallest node of the component.

    Each step takes the least label among the neighbours and then the label of that label.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("far"))
        moved = cut(step.join(jump, "to").select("node", F.col("label").alias("was"), F.least("to", "far").alias("label")))
        labels = moved.select("node", "label")
        if not moved.where("label <> was").limit(1).count():
            return labels


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of which 100 * common shingles reach percent * all shingles."""
    of = lambda x, *columns: sets.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])
    near = pairs.join(of("a", "n", "odd"), "a").join(of("b", "n", "odd"), "b")
    most = (F.col("n_a") + F.col("n_b")) * F.lit((100 - percent) / (100 + percent))
    ones = F.aggregate(F.zip_with("odd_a", "odd_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    near = near.where(ones <= most).select("a", "b")
    got = near.distinct().join(of("a", "set"), "a").join(of("b", "set"), "b")
    got = got.select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("both"), (F.size("set_a") + F.size("set_b")).alias("all"))
    return got.where(100 * F.col("both") >= percent * (F.col("all") - F.col("both"))).select("a", "b")


def _links(part: pa.Table, percent: int) -> pa.Table:
    """Links (a, b) that join all labels of a part which its pairs join: those that share a table, and `group` as their first group.

    A pair is skipped only if its labels are one already, by the input or by links found here.
    """
    group, p, q = (part[c][0].as_py() for c in ("group", "p", "q"))
    node, label, block = part["node"].to_numpy(), part["label"].to_numpy().copy(), part["block"].to_numpy()
    sets = part["set"].combine_chunks()
    n = sets.value_lengths().to_numpy().astype(np.int64)
    ends = np.cumsum(n)
    vocabulary, ids = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    sig = part["sig"].combine_chunks().flatten().to_numpy().reshape(len(node), -1)
    half = sig.shape[1] // 2
    mark = np.zeros(len(vocabulary), bool)
    found = []
    for x in np.flatnonzero(block == p):
        may = (label != label[x]) & (block == q) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
        if p == q:
            may[: x + 1] = False
        ys = np.flatnonzero(may)
        same = sig[ys] == sig[x]
        ys = ys[(same[:, :half].argmax(axis=1) == group) & same[:, half:].any(axis=1)]
        if not len(ys):
            continue
        own = ids[ends[x] - n[x] : ends[x]]
        mark[own] = True
        starts = np.cumsum(n[ys]) - n[ys]
        at = np.repeat(ends[ys] - n[ys] - starts, n[ys]) + np.arange(n[ys].sum())
        both = np.add.reduceat(mark[ids[at]], starts, dtype=np.int64)
        mark[own] = False
        for y in ys[100 * both >= percent * (n[x] + n[ys] - both)]:
            if label[y] != label[x]:
                found.append((min(node[x], node[y]), max(node[x], node[y])))
                label[label == label[y]] = label[x]
    found = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"a": found[:, 0], "b": found[:, 1]})


def _may_link(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The nodes of rows (node, label) that share one of their rarest shingles with another label; the others can't have a link to one.

    Two linked sets have at least percent of each in common, so in any order of all shingles the first common one
    is among the first n - ceil(percent * n / 100) + 1 of both. Rare ones come first here: pages of one template,
    each with more text of its own than a link allows, share none of these.
    """
    each = stored(rows.join(sets.select("node", "n", "set"), "node").select("node", "label", "n", F.explode("set").alias("shingle")), "left-shingles")
    # written out, so that the joins deal both sides anew and may split a shingle that very many sets share
    times = stored(each.groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1"), "left-times")
    rarest = Window.partitionBy("node").orderBy(F.coalesce("times", F.lit(1)), "shingle")
    firsts = each.join(times, "shingle", "left").withColumn("at", F.row_number().over(rarest)).where(100 * (F.col("n") - F.col("at") + 1) >= percent * F.col("n"))
    firsts = stored(firsts.select("node", "label", "shingle"), "left-firsts")
    mixed = stored(firsts.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("shingle"), "left-mixed")
    nodes = cut(firsts.join(mixed, "shingle", "left_semi").select("node").distinct())
    drop_stored(each, times, firsts, mixed)
    return nodes


def _left_sizes(wide: DataFrame) -> DataFrame:
    """(group, value, blocks) of the group values with rows of several labels."""
    sizes = wide.groupBy("group", "value").agg(F.sum("n").alias("all"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    return stored(sizes.where("lo <> hi").select("group", "value", F.ceil(F.col("all") / PART_SHINGLES).alias("blocks")), "group-sizes")


def _links_left(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between labels of rows (node, n, label, sig): every pair of rows that shares a table and can be a link is compared.

    Such a pair shares a group of the first collection. The rows of each group value are dealt into blocks,
    and each two blocks form a part; a row has as many copies as its group value has blocks, mostly one. Group
    values of several blocks first lose the rows that can't have a link at all (_may_link), before any copy is made.
    """
    wide = stored(rows.select("node", "n", "label", "sig", F.posexplode(F.slice("sig", 1, F.size("sig") / 2)).alias("group", "value")), "groups-left")
    sizes = _left_sizes(wide)
    large = sizes.where("blocks > 1")
    if not large.isEmpty():
        may = _may_link(cut(wide.join(large, ["group", "value"]).select("node", "label").distinct()), sets, percent)
        left = wide.join(sizes, ["group", "value"]).join(may.withColumn("may", F.lit(True)), "node", "left").where("blocks = 1 or may")
        left = stored(left.select(*wide.columns), "groups-left")
        drop_stored(wide, sizes)
        wide, sizes = left, _left_sizes(left)
    dealt = wide.join(sizes, ["group", "value"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = dealt.select("group", "value", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "node", "label", "sig")
    parts = dealt.join(sets.select("node", "set"), "node").groupBy("group", "value", "p", "q")
    ship(rows.sparkSession)
    found = cut(parts.applyInArrow(lambda part: _links(part, percent), "a bigint, b bigint").distinct())
    drop_stored(wide, sizes)
    return found


def _labelled(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, lower: bool) -> DataFrame:
    """(doc_id, tie, n_shingles, first) of each row; first is the least (doc_id, tie) of its component, null for rows that are linked with nothing."""
    groups = groups_for(percent)
    seeds = corpus_key(docs, text_col)
    sig = stored(signatures(docs, id_col, text_col, k, groups, seeds, lower), "signatures")
    classes = sig.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "tie")).alias("least"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # numbers are read from this table only
    table = F.explode(F.sequence(F.lit(0), F.lit(groups * groups - 1))).alias("table")
    keys = classes.select("node", "n", "sig", table)
    key = F.xxhash64(F.get("sig", F.floor(F.col("table") / groups).cast("int")), F.get("sig", F.lit(groups) + F.col("table") % groups), "table")
    keys = keys.select(key.alias("key"), F.struct("node", "n").alias("at"))
    ends = keys.groupBy("key").agg(F.min("at.node").alias("least"), F.max("at.node").alias("most"))
    # written out, so that the join deals both sides anew and may split the bucket of a very large group
    shared = stored(ends.where("least <> most").select("key", "least"), "shared-keys")
    buckets = stored(keys.join(shared, "key").select("key", "at.node", "at.n", "least"), "buckets")
    ids = cut(classes.select("node", "least.*").join(buckets.select("node").distinct(), "node", "left_semi"))
    sets = shingle_sets(docs, ids, id_col, text_col, k, seeds[1], lower)
    could = lambda n, m: 100 * F.least(n, m) >= percent * F.greatest(n, m)  # noqa: E731  sets of such sizes can be as alike
    hub = buckets.where("node = least").select("key", F.col("n").alias("hub_n"))
    tested = buckets.where("node <> least").join(hub, "key").where(could(F.col("n"), F.col("hub_n")))
    tested = cut(tested.select(F.col("least").alias("a"), F.col("node").alias("b")).distinct())
    labels = components(cut(_confirmed(tested, sets, percent)))
    rows = buckets.where("node <> least").select("key", "node", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    rows = cut(rows.join(mixed, "key").select("node", "n", "label").distinct())
    found = _links_left(rows.join(classes.select("node", "sig"), "node"), sets, percent)
    of = rows.select("node", "label")
    ends = found.join(of.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(of.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
    merged = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("label"), F.col("label").alias("new"))
    alone = merged.select(F.col("label").alias("node"), F.col("new").alias("label")).join(labels, "node", "left_anti")
    labels = cut(labels.join(merged, "label", "left").select("node", F.coalesce("new", "label").alias("label")).union(alone))
    of = cut(classes.select("set_a", "set_b", "node", "least").join(labels, "node", "left"))
    firsts = of.where("label is not null").groupBy("label").agg(F.min("least").alias("first"))
    of = of.join(firsts, "label", "left").select("set_a", "set_b", F.coalesce("first", "least").alias("first"))
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    out = sig.select("doc_id", "tie", "n_shingles", "set_a", "set_b").join(of, ["set_a", "set_b"], "left")
    out = stored(out.select("doc_id", "tie", "n_shingles", F.when(linked, F.col("first")).alias("first")), "components")
    drop_stored(sig, classes, shared, buckets, sets)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 85, lower: bool = True) -> DataFrame:
    """One row per row of docs: (doc_id, n_shingles, component_id, kept); component_id is the least id of the component."""
    rows = _labelled(docs, id_col, text_col, k, percent, lower)
    component = F.coalesce("first.doc_id", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs, whatever their columns, with one row of each component.

    Defined results: the row of the least id stays (of one id with two texts, that of the lesser hash of the text; of
    rows that agree in id and text, any one); texts without a word and rows without an id all stay; a unique
    text always stays, also under an id that another text has; an empty table gives an empty one.
    """
    rows = _labelled(docs, id_col, text_col, k, percent, True).where("first is not null")
    each = cut(rows.groupBy("doc_id", "tie").agg(F.count("*").alias("times"), F.first("first").alias("first")))
    own = F.struct("doc_id", "tie") == F.col("first")
    gone = each.where(~own).select("doc_id", "tie")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tie"))
    left = whole.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, ["doc_id", "tie"], "left_anti")
    again = each.where(own & (F.col("times") > 1)).select("doc_id", "tie")
    n = again.count()
    if n:
        again = F.broadcast(again) if n <= BROADCAST_IDS else again
        one = left.join(again, ["doc_id", "tie"], "left_semi").groupBy("doc_id", "tie").agg(F.first("row").alias("row"))
        left = left.join(again, ["doc_id", "tie"], "left_anti").select("row").union(one.select("row"))
    return left.select(*[F.col(f"row.`{c}`") for c in docs.columns])
