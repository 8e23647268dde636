"""Hard negatives for anchors and their positives, by branch and bound over ball trees.

All vectors are dealt by a hash into chunks of bounded size; each chunk holds a ball tree for each label. Anchors
visit every chunk: a node with centre c and radius r bounds the inner products of all its vectors x with
an anchor q by q.c - |q| r <= q.x <= q.c + |q| r. Nodes are pruned whose bounds lie outside the query's window of
scores, or strictly beneath the k-th score it has found there so far. A node is visited by all anchors that it isn't
pruned for at once, so bounds and scores are products of small matrices.

Two searches of this kind follow each other: the first positives (same label, any score), and for each distinct
score of a positive the first negatives (other labels, scores in its window). Each chunk gives a few rows
for each query, which are ranked again over all chunks. Chunks and anchors meet by a join on the chunk: the
rows of a chunk arrive first, then the anchors one by one, so a task holds one chunk and a block of anchors, whatever
the size of the tables. Work grows with anchors times vectors, as far as nothing is pruned.

Components become integers by floor(scale * x); scores are exact integers. Components beyond LARGEST
in size count as LARGEST, so that scores fit 64 bits.

Defined results: rows with a null id, label, vector or component, or a component that isn't finite, take no
part; vectors of another length than the longest count as followed by zeros; equal rows are rows of their own (a
repeated anchor gives its rows as often as it comes, a repeated positive or negative takes several places); ties go to the smaller
id; anchors without a positive, or positives without a negative, give no row; other columns, whatever their names, are left
alone; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import drop_stored, map_batches, stored

#: Vectors of a chunk, in expectation, and the least that a chunk is made for; of a leaf; anchors that search together.
CHUNK_ROWS, LEAST_ROWS, LEAF_ROWS, BLOCK_ROWS = 16_384, 512, 64, 2_048
#: The largest component in size: 64 of them still give scores below 2**63.
LARGEST = 1 << 27
#: Products below this are exact as floats.
_EXACT = float(1 << 52)
_NEVER = np.iinfo(np.int64).max


class BallTree:
    """A ball tree over integer vectors: nodes with centre, radius, children, and rows in leaf order."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF_ROWS):
        self.x = vectors.astype(np.float64)
        self.order = np.arange(len(vectors))
        self.nodes: list[tuple[int, int, int, int]] = []  # first row, end, left child, right child
        centres, radii = [], []
        todo = [(0, len(vectors), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            own = self.x[self.order[a:b]]
            centre = own.mean(axis=0)
            centres.append(centre)
            radii.append(float(np.sqrt(((own - centre) ** 2).sum(axis=1).max())))
            at = len(self.nodes)
            self.nodes.append((a, b, -1, -1))
            if parent >= 0:
                p = self.nodes[parent]
                self.nodes[parent] = (*p[:2], at, p[3]) if side == 0 else (*p[:3], at)
            if b - a > leaf and radii[-1] > 0:
                # split at the median along the line between a far vector and the one farthest from it
                far = own[((own - centre) ** 2).sum(axis=1).argmax()]
                line = own[((own - far) ** 2).sum(axis=1).argmax()] - far
                half = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own @ line, half)]
                todo += [(a, a + half, at, 0), (a + half, b, at, 1)]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.size = np.sqrt((self.centres**2).sum(axis=1)) + self.radii


class Queries:
    """Queries (vector, least and most score) with their best k (score, id) so far, best first."""

    def __init__(self, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        self.q, self.low, self.high, self.k = vectors.astype(np.float64), low, high, k
        self.norm = np.sqrt((self.q**2).sum(axis=1))
        self.score = np.full((len(vectors), k), -_NEVER)
        self.id = np.full((len(vectors), k), _NEVER)

    def search(self, tree: BallTree, ids: np.ndarray, who: np.ndarray) -> None:
        """Let the queries `who` visit a tree whose row i has the id ids[i]."""
        todo = [(0, who)]
        while todo:
            node, who = todo.pop()
            mid, reach = self.q[who] @ tree.centres[node], self.norm[who] * tree.radii[node]
            reach = reach + 0.5 + 1e-9 * self.norm[who] * tree.size[node]  # room for rounding; scores are integers
            near = (mid + reach >= np.maximum(self.low[who], self.score[who, -1])) & (mid - reach <= self.high[who])
            who = who[near]
            if not len(who):
                continue
            a, b, left, right = tree.nodes[node]
            if left < 0:
                self._look(tree, ids, tree.order[a:b], who)
                continue
            ahead = self.q[who] @ (tree.centres[left] - tree.centres[right])
            first, last = (left, right) if ahead.sum() >= 0 else (right, left)
            todo += [(last, who), (first, who)]  # the nearer child is visited first

    def _look(self, tree: BallTree, ids: np.ndarray, rows: np.ndarray, who: np.ndarray) -> None:
        x, q = tree.x[rows], self.q[who]
        if np.sqrt((x**2).sum(axis=1)).max() * self.norm[who].max() < _EXACT:
            got = (q @ x.T).astype(np.int64)
        else:
            got = q.astype(np.int64) @ x.astype(np.int64).T
        worst, low, high = self.score[who, -1], self.low[who], self.high[who]
        fits = (got >= np.maximum(low, worst)[:, None]) & (got <= high[:, None])
        some = np.flatnonzero(fits.any(axis=1))
        if not len(some):
            return
        new = np.where(fits[some], got[some], -_NEVER)
        score = np.concatenate([self.score[who[some]], new], axis=1)
        number = np.concatenate([self.id[who[some]], np.where(fits[some], ids[rows], _NEVER)], axis=1)
        best = np.lexsort((number, -score), axis=1)[:, : self.k]
        self.score[who[some]] = np.take_along_axis(score, best, axis=1)
        self.id[who[some]] = np.take_along_axis(number, best, axis=1)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """Rows of the integer vectors of a batch, padded with zeros to a common width."""
    sizes, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy()
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int32)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _searched(rows: DataFrame, width: int, k: int, same_label: bool) -> DataFrame:
    """(query, score, row_id): the best k rows of each chunk for each query of the chunk.

    rows: (chunk, kind, row_id, label, vector, low, high); kind 0 is a vector of the chunk, kind 1 a query (row_id is its
    number). They come chunk by chunk, and in a chunk vectors come first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, parts, held = None, [], []
        trees: list[tuple[int, BallTree, np.ndarray]] | None = None

        def grown() -> list[tuple[int, BallTree, np.ndarray]]:
            ids, labels, vectors = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
            return [(int(y), BallTree(vectors[labels == y]), ids[labels == y]) for y in np.unique(labels)]

        def answered() -> pa.RecordBatch:
            number, labels, vectors, low, high = (np.concatenate(x) for x in zip(*held))
            found = Queries(vectors, low, high, k)
            for label, tree, ids in trees:
                found.search(tree, ids, np.flatnonzero((labels == label) == same_label))
            who, place = np.nonzero(found.id != _NEVER)
            return pa.RecordBatch.from_arrays([pa.array(number[who]), pa.array(found.score[who, place]), pa.array(found.id[who, place])], ["query", "score", "row_id"])

        for batch in batches:
            chunks, kinds = (batch.column(c).to_numpy() for c in (0, 1))
            border = np.flatnonzero((np.diff(chunks) != 0) | (np.diff(kinds) != 0)) + 1
            ends = [*border.tolist(), batch.num_rows]
            for a, b in zip([0, *border.tolist()], ends):
                if a == b:
                    continue
                if chunks[a] != chunk:
                    if held:
                        yield answered()
                    chunk, parts, held, trees = chunks[a], [], [], None
                own = batch.slice(a, b - a)
                ids, labels = (own.column(c).to_numpy() for c in (2, 3))
                vectors = _vectors(own.column(4), width)
                if kinds[a] == 0:
                    parts.append((ids, labels, vectors))
                    continue
                trees = grown() if trees is None else trees
                held.append((ids, labels, vectors, own.column(5).to_numpy(), own.column(6).to_numpy()))
                if sum(len(x[0]) for x in held) >= BLOCK_ROWS:
                    yield answered()
                    held = []
        if held:
            yield answered()

    return map_batches(rows, run, "query bigint, score bigint, row_id bigint")


def _search(index: DataFrame, queries: DataFrame, chunks: int, width: int, k: int, same_label: bool) -> DataFrame:
    """(query, score, row_id, place): the best k rows of the index for each query (query, label, vector, low, high)."""
    none = F.lit(None).cast("bigint")
    vectors = index.select("chunk", F.lit(0).alias("kind"), F.col("vec_id").alias("row_id"), "label", "vector", none.alias("low"), none.alias("high"))
    every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    asked = queries.select(every, F.lit(1).alias("kind"), F.col("query").alias("row_id"), "label", "vector", "low", "high")
    rows = vectors.unionByName(asked).repartition(chunks, "chunk").sortWithinPartitions("chunk", "kind")
    found = _searched(rows, width, k, same_label)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "row_id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def _whole(vector: Column, scale: int) -> Column:
    """Components as integers."""
    bound = lambda x: F.least(F.greatest(x.cast("double") * scale, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))
    return F.transform(vector, lambda x: F.floor(bound(x)).cast("int"))


def usable(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """(vec_id, label, vector, times) of the rows that take part; equal rows are one, with their number."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    some = rows.where(F.col(id_col).isNotNull() & label.isNotNull() & v.isNotNull()).where(~bad)
    some = some.select(F.col(id_col).cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), _whole(v, scale).alias("vector"))
    return some.groupBy("vec_id", "label", "vector").agg(F.count("*").cast("int").alias("times"))


def mine(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, anchor: Column | None = None, positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, positive_place, rank, negative_id, positive_score, negative_score).

    label: what tells positives from negatives (default: column label); anchor: which rows are anchors, over vec_id
    (default: ids divisible by 50). Negatives score from low_percent to high_percent of their positive.
    """
    label = F.col("label") if label is None else label
    anchor = F.col("vec_id") % 50 == 0 if anchor is None else anchor
    every = stored(usable(rows, id_col, vector_col, label, scale), "vectors")
    facts = every.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    width = max(1, facts["width"] or 0)
    wide = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(1, -(-facts["n"] // CHUNK_ROWS), min(wide, facts["n"] // LEAST_ROWS))
    # a repeated row can take as many places as a search gives
    most = max(positives + 1, negatives)
    index = every.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(most)))))
    index = index.withColumn("chunk", F.pmod(F.xxhash64("vec_id", "vector", "__copy"), F.lit(chunks)).cast("int"))
    anchors = stored(every.where(anchor).withColumn("query", F.monotonically_increasing_id()), "anchors")  # numbers are read from this table only
    asked = anchors.select("query", "label", "vector", F.lit(-_NEVER).alias("low"), F.lit(_NEVER).alias("high"))
    near = _search(index, asked, chunks, width, positives + 1, True)
    # the anchor itself is one of the rows of its id and own score, if these are among the first
    own = _search_self(anchors)
    near = near.join(own, "query").withColumn("itself", (F.col("row_id") == F.col("anchor_id")) & (F.col("score") == F.col("own_score")))
    gone = F.min(F.when(F.col("itself"), F.col("place"))).over(Window.partitionBy("query"))
    near = near.withColumn("gone", gone).where(F.col("gone").isNull() | (F.col("place") != F.col("gone")))
    place = F.col("place") - F.when(F.col("gone") < F.col("place"), 1).otherwise(0)
    near = near.select("query", "anchor_id", F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score"), place.alias("positive_place")).where(F.col("positive_place") <= positives)
    near = stored(near, "positives")
    scores = near.where("positive_score >= 0").select("query", "positive_score").distinct()
    low, high = F.expr(f"(positive_score * {low_percent} + 99) div 100"), F.expr(f"(positive_score * {high_percent}) div 100")
    windows = scores.withColumns({"low": low, "high": high}).where("low <= high").withColumn("asker", F.monotonically_increasing_id())
    windows = stored(windows, "windows")
    asked = windows.join(anchors.select("query", "label", "vector"), "query").select(F.col("asker").alias("query"), "label", "vector", "low", "high")
    found = _search(index, asked, chunks, width, negatives, False)
    found = found.select(F.col("query").alias("asker"), F.col("place").alias("rank"), F.col("row_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = near.join(windows.select("asker", "query", "positive_score"), ["query", "positive_score"]).join(found, "asker")
    out = out.join(anchors.select("query", F.explode(F.sequence(F.lit(1), "times")).alias("__copy")), "query")
    out = stored(out.select("anchor_id", "positive_id", "positive_place", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    drop_stored(every, anchors, near, windows)
    return out


def _search_self(anchors: DataFrame) -> DataFrame:
    """(query, anchor_id, own_score): the inner product of each anchor with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [int((np.array(x, np.int64) ** 2).sum()) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int64())], ["query", "anchor_id", "own_score"])

    return map_batches(anchors.select("query", "vec_id", "vector"), run, "query bigint, anchor_id bigint, own_score bigint")
