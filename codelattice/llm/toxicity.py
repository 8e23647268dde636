"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are lower-cased words and their stems (the first STEMS bytes), told apart by 64-bit hashes. Of the terms of the
labelled examples, near copies counted once, those stay whose presence goes with the label (chi-square at least CHI, and
PHI of the number of examples): the rest says nothing about toxicity, and would fill the neighbourhood by topic. A text's vector
has (1 + ln tf) * idf for each of these terms, idf over all documents, and length 1.

The examples are sorted by their heaviest terms and cut into blocks of BLOCK. The index has, for each term, the greatest
weight in each block, and the postings of each block. A text visits blocks in the order of their bounds, the
sum of its weights times the blocks' greatest ones, until no bound reaches its k-th similarity; so its k nearest examples
are exact. They vote with their similarities; votes are calibrated by a logistic curve, fitted to the votes of a fold of
examples in an index without that fold. Texts without an example in reach get the rate of such texts in the fold.

What is learnt from labels is fitted on at most SAMPLE labelled rows (in expectation, drawn by a hash of the id, whatever
their label), so the index has at most SAMPLE * TERMS postings and is sent with the tasks; document counts of terms,
and scores, cover all documents. Texts are read once for their terms, which are written as a narrow table.

Defined results: null and empty texts, and texts without a term of the index, get the rate of texts without a term; equal
texts get equal scores; of several labels of one id the greatest counts, labels without an id or value don't;
similarities are compared to 9 decimals, and ties go to the smaller id; without labelled rows every score is 0; an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import cut, drop_stored, map_batches, stored
from .words import hash_spans, pieces, shingles, word_hashes

#: Labelled rows that are learnt from at most, in expectation.
SAMPLE = 20_000
#: Terms of the index at most; least chi-square of a term, as such and as a share of the examples; least examples with it.
TERMS, CHI, PHI, LEAST_DOCS = 1_024, 25.0, 0.01, 5
#: Lengths of stems, in bytes.
STEMS = (4, 6)
NEAREST, BLOCK = 15, 64
#: One in so many examples calibrates.
FOLDS = 4
_CLOSE = 1e-9
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, term) of all words and stems of the documents of a piece; words are runs of letters, A-Z count as a-z."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    letter = _LETTER[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    starts = np.flatnonzero(letter & (border[:-1] | ~np.concatenate([[False], letter[:-1]])))
    ends = np.flatnonzero(letter & (border[1:] | ~np.concatenate([letter[1:], [False]]))) + 1
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    docs, terms = [doc], [hash_spans(low, starts, ends)]
    for n in STEMS:
        long = ends - starts > n
        docs.append(doc[long])
        terms.append(hash_spans(low, starts[long], starts[long] + n, seed=n))
    return np.concatenate(docs), np.concatenate(terms)


def _counted(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, term) pairs in order, and how often they come."""
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    first = np.flatnonzero(new)
    return doc[first], term[first], np.diff(np.append(first, len(doc)))


def _lists(values: np.ndarray, doc: np.ndarray, n: int) -> pa.Array:
    """values, ordered by doc, as a list for each of n documents."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def document_terms(docs: DataFrame, known: np.ndarray | None = None) -> DataFrame:
    """docs (key..., text) with `terms` and `tf` instead of the text: distinct terms and their counts.

    With known, sorted hashes, only these are looked for, and terms are places in known.
    """
    keys = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in pieces(batch.column(len(keys))):
                doc, term = terms_of(data, offsets)
                if known is not None:
                    place = np.searchsorted(known, term)
                    hit = np.flatnonzero(known[np.minimum(place, len(known) - 1)] == term) if len(known) else np.zeros(0, np.int64)
                    doc, term = doc[hit], place[hit].astype(np.uint64)
                doc, term, tf = _counted(doc, term)
                own = [batch.column(i).slice(at, to - at) for i in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*own, _lists(term.view(np.int64), doc, to - at), _lists(tf.astype(np.int32), doc, to - at)], [*keys, "terms", "tf"])

    schema = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keys)
    return map_batches(docs.select(*keys, "text"), run, f"{schema}, terms array<bigint>, tf array<int>")


def sketched(examples: DataFrame) -> DataFrame:
    """examples with `sketch`, the least hash of a 3-word shingle: mostly the same in near copies, hardly in others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in pieces(batch.column(2)):
                h, _, _, firsts = word_hashes(data, offsets, lower=True)
                values, places = shingles(h, firsts, 3)
                least = np.zeros(to - at, np.uint64)
                full = np.diff(places) > 0
                if full.any():
                    least[full] = np.minimum.reduceat(values, places[:-1][full])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(at, to - at) for i in range(3)), pa.array(least.view(np.int64))], ["doc_id", "label", "text", "sketch"])

    return map_batches(examples.select("doc_id", "label", "text"), run, "doc_id bigint, label int, text string, sketch bigint")


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, place) of all places of the ranges."""
    n = ends - starts
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)


class BlockMaxIndex:
    """Examples (sparse vectors of length 1, labels, ids) under a block-max inverted index."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, labels: np.ndarray, ids: np.ndarray, n_terms: int):
        self.n, self.n_terms = len(labels), n_terms
        # examples with the same heaviest terms stand together, so that blocks have tight bounds
        heavy = np.full((self.n, 2), n_terms)
        order = np.lexsort((term, -weight, doc))
        first = np.searchsorted(doc[order], np.arange(self.n + 1))
        for j in range(2):
            some = np.flatnonzero(np.diff(first) > j)
            heavy[some, j] = term[order][first[some] + j]
        sorted_ = np.lexsort((ids, heavy[:, 1], heavy[:, 0]))
        place = np.empty(self.n, np.int64)
        place[sorted_] = np.arange(self.n)
        self.labels, self.ids = labels[sorted_], ids[sorted_]
        self.blocks = -(-self.n // BLOCK)
        doc = place[doc]
        order = np.lexsort((doc, term, doc // BLOCK))
        self.doc, self.weight = doc[order], weight[order]
        key = self.doc // BLOCK * n_terms + term[order]
        self.keys, self.first = np.unique(key, return_index=True)
        self.end = np.append(self.first[1:], len(key))
        most = np.maximum.reduceat(self.weight, self.first) if len(key) else self.weight
        by_term = np.lexsort((self.keys // n_terms, self.keys % n_terms))
        self.most_block, self.most = (self.keys // n_terms)[by_term], most[by_term]
        self.of_term = np.searchsorted((self.keys % n_terms)[by_term], np.arange(n_terms + 1))

    def nearest(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        """(similarity, example) of the k nearest examples of n texts, best first; similarity 0 where there are fewer."""
        best, who = np.zeros((n, k)), np.full((n, k), self.n)
        if not self.n or not len(doc):
            return best, who
        number = np.append(self.ids, np.iinfo(np.int64).max)
        which, at = _ranges(self.of_term[term], self.of_term[term + 1])
        bounds = np.bincount(doc[which] * self.blocks + self.most_block[at], weight[which] * self.most[at], n * self.blocks).reshape(n, self.blocks)
        order = np.argsort(-bounds, axis=1, kind="stable")
        start = np.searchsorted(doc, np.arange(n + 1))
        active = np.arange(n)
        for r in range(self.blocks):
            block = order[active, r]
            bound = bounds[active, block]
            near = (bound > 0) & (bound + 2 * _CLOSE >= best[active, -1])
            active, block = active[near], block[near]
            if not len(active):
                break
            text, entry = _ranges(start[active], start[active + 1])
            key = block[text] * self.n_terms + term[entry]
            spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[spot] == key
            text, entry, spot = text[hit], entry[hit], spot[hit]
            which, posting = _ranges(self.first[spot], self.end[spot])
            slot = text[which] * BLOCK + self.doc[posting] % BLOCK
            like = np.bincount(slot, weight[entry[which]] * self.weight[posting], len(active) * BLOCK).reshape(len(active), BLOCK).round(9)
            example = np.minimum(block[:, None] * BLOCK + np.arange(BLOCK), self.n)
            example = np.where(like > 0, example, self.n)
            like, example = np.concatenate([best[active], like], axis=1), np.concatenate([who[active], example], axis=1)
            first = np.lexsort((number[example], -like), axis=1)[:, :k]
            best[active], who[active] = np.take_along_axis(like, first, axis=1), np.take_along_axis(example, first, axis=1)
        return best, who


class Model(NamedTuple):
    terms: np.ndarray
    idf: np.ndarray
    index: BlockMaxIndex
    curve: tuple[float, float]
    #: Score of texts without an example in reach.
    alone: float

    def weights(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int) -> np.ndarray:
        w = (1 + np.log(tf)) * self.idf[term]
        norm = np.sqrt(np.bincount(doc, w * w, n))
        return w / np.where(norm > 0, norm, 1)[doc]

    def votes(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(share of the toxic among the nearest by similarity, NaN without any; similarities; examples)."""
        like, who = self.index.nearest(doc, term, self.weights(doc, term, tf, n), n)
        total = like.sum(axis=1)
        toxic = (like * np.append(self.index.labels, 0)[who]).sum(axis=1)
        return np.where(total > 0, toxic / np.where(total > 0, total, 1), np.nan), like, who

    def score(self, vote: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return np.where(np.isnan(vote), self.alone, 1 / (1 + np.exp(-np.clip(a * np.nan_to_num(vote) + b, -30, 30))))


def _curve(vote: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic curve through votes, fitted by Newton steps to labels drawn in from 0 and 1 by their number."""
    yes = label.sum()
    target = np.where(label == 1, (yes + 1) / (yes + 2), 1 / (len(label) - yes + 2))
    x = np.stack([vote, np.ones(len(vote))], axis=1)
    w = np.array([4.0, -2.0])  # a vote of one half is even
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (target - p) - 0.01 * (w - [4.0, -2.0])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2), slope)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def labelled(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, label, text): a bounded sample of the labelled rows that aren't held out, each text once for an id."""
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("doc_id")).agg(F.max(F.col(label_col)).cast("int").alias("label"))
    own = own.where(~held_out)
    n = own.count()
    rate = min(1.0, sample / max(1, n))
    drawn = own.where(F.crc32(F.concat(F.lit("example:"), F.col("doc_id").cast("string"))) < int(rate * (1 << 32)))
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    return texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "label", "text").distinct()  # drawn has about `sample` rows


def train(docs: DataFrame, examples: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model of examples (doc_id, label, text), and the table (row, terms, tf) of all docs for it.

    row: a struct of doc_id, the only column of docs that is carried along.
    """
    seen = stored(document_terms(sketched(examples)), "examples")
    # near copies count as one: else each word of theirs would seem to go with their label
    once = seen.groupBy("sketch").agg(F.max_by(F.struct("label", "terms"), "doc_id").alias("one")).select("one.*")
    total = {r["label"]: r["n"] for r in once.groupBy("label").agg(F.count("*").alias("n")).collect()}
    yes, no = total.get(1, 0), total.get(0, 0)
    each = once.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count_if(F.col("label") == 1).cast("double").alias("a"), F.count_if(F.col("label") != 1).cast("double").alias("b"))
    a, b, n = F.col("a"), F.col("b"), float(max(1, yes + no))
    off = a * (no - b) - b * (yes - a)
    chi = n * off * off / ((a + b) * F.greatest(n - a - b, F.lit(1.0)) * float(max(1, yes)) * float(max(1, no)))
    best = each.where((a + b >= LEAST_DOCS) & (a + b < n)).withColumn("chi", chi).where(F.col("chi") >= max(CHI, PHI * n)).orderBy(F.desc("chi"), "term").limit(TERMS)
    known = np.sort(np.array([r["term"] for r in best.select("term").collect()], np.int64).view(np.uint64))  # TERMS at most
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = stored(document_terms(rows, known), "document-terms")
    idf = np.log1p(np.full(len(known), float(found.count())))
    for r in found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect():  # TERMS rows at most
        idf[r["term"]] = np.log(1 + np.exp(idf[r["term"]]) / r["n"])
    place = {int(h): i for i, h in enumerate(known)}
    some = F.filter(F.arrays_zip("terms", "tf"), lambda x: x["terms"].isin(*[int(x) for x in known.view(np.int64)]) if len(known) else F.lit(False))
    got = seen.select("doc_id", "label", some.alias("some")).orderBy("doc_id").collect()  # a row an example, with its terms of the index
    drop_stored(seen)
    fold = np.array([_fold(r["doc_id"]) for r in got], int)
    label = np.array([r["label"] for r in got], np.int64)

    def sparse(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        triples = sorted((i, place[x["terms"] % (1 << 64)], x["tf"]) for i, k in enumerate(of) for x in got[k]["some"])
        doc, term, tf = np.array(triples, np.int64).reshape(-1, 3).T
        return doc, term, tf

    ids = np.array([r["doc_id"] for r in got], np.int64)
    empty = BlockMaxIndex(*(np.zeros(0, np.int64),) * 2, np.zeros(0), *(np.zeros(0, np.int64),) * 2, max(1, len(known)))
    model = Model(known, idf, empty, (4.0, -2.0), 0.0)

    def indexed(of: np.ndarray) -> Model:
        doc, term, tf = sparse(of)
        return model._replace(index=BlockMaxIndex(doc, term, model.weights(doc, term, tf, len(of)), label[of], ids[of], max(1, len(known))))

    outside = np.flatnonzero(fold == 0)
    vote, _, _ = indexed(np.flatnonzero(fold != 0)).votes(*sparse(outside), len(outside))
    near = ~np.isnan(vote)
    alone = label[outside][~near]
    if near.any():
        model = model._replace(curve=_curve(vote[near], label[outside][near]))
    model = model._replace(alone=float((alone.sum() + yes / n) / (len(alone) + 1)) if got else 0.0)
    return indexed(np.arange(len(got))), found


def _fold(doc_id: int) -> int:
    return int(hash_spans(np.frombuffer(b"%d" % doc_id, np.uint8), np.array([0]), np.array([len(b"%d" % doc_id)]), 5)[0] >> np.uint64(20)) % FOLDS


def score(found: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, evidence) of each row of document terms; evidence: the nearest examples with similarity and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, terms, tf = batch.num_rows, batch.column(1), batch.column(2)
            doc = np.repeat(np.arange(n), terms.value_lengths().to_numpy())
            vote, like, who = model.votes(doc, terms.flatten().to_numpy(), tf.flatten().to_numpy(), n)
            row, col = np.nonzero(like > 0)
            near = who[row, col]
            structs = pa.StructArray.from_arrays([pa.array(model.index.ids[near]), pa.array(like[row, col]), pa.array(model.index.labels[near].astype(np.int32))], ["doc_id", "similarity", "label"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), structs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(vote)), lists], ["doc_id", "score", "evidence"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return map_batches(found, run, f"doc_id {kind}, score double, evidence array<struct<doc_id:bigint,similarity:double,label:int>>")


def toxicity(docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of each row of docs. held_out: a function of the id column; such rows aren't learnt from."""
    examples = cut(labelled(docs, labels, held_out(F.col("doc_id")), id_col, text_col, label_col, sample))
    model, found = train(docs, examples, id_col, text_col)
    out = stored(score(found, model), "toxicity")
    drop_stored(found)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
