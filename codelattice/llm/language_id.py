"""Language identification by interpolated Kneser-Ney character models.

Text is lower-cased; letters stay and every run of other characters is one blank. From a bounded,
hash-drawn sample of labelled documents, the 4-grams of each language are counted on the executors;
all lower orders follow from the distinct 4-grams, as Kneser-Ney wants them. The models of all
languages share one sorted array of 64-bit hashes for each order, with one row of log-probabilities
(a column for each language), and an index of their leading bits in place of a binary search. A
document gets the language with the lowest cross-entropy per character.

Rejection is calibrated on part of the sample that trains nothing: its squared distances from the
language's mean cross-entropy are fitted by a part for each document and a part that falls with length,
and a document is rejected beyond REJECT_SD such deviations.

Defined results: null texts and texts without a letter are `und` with score 0 and rejected; so is
every text if no labelled row exists. Documents of any length are read whole. Equal texts get equal
results. Other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_batches
from .words import mix, pieces

ORDER = 4
#: Labelled documents of each language that are drawn to fit and calibrate a model, in expectation.
SAMPLE_DOCS = 2_000
#: Of these, one in so many calibrates.
CALIBRATE = 5
REJECT_SD, REJECT_NATS = 8.0, 0.5
#: Turns a gap in nats per character into a score.
SHARPNESS = 12.0
_BREAK = 1
_BLANK = 32
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def normalised(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts with ORDER - 1 breaks before each, place of each text's first break, and one more)."""
    gap = chr(_BREAK) * (ORDER - 1)
    flat = "".join(gap + (t.replace(gap[0], " ").lower() if t else "") for t in texts)
    at = np.frombuffer(flat.encode("utf-32-le"), "<u4")
    letter, brk = _letter_table()[at], at == _BREAK
    keep = letter | brk
    keep[1:] |= letter[:-1] & ~brk[1:]
    out = np.where(letter | brk, at, _BLANK)[keep].astype(np.uint64)
    breaks = np.flatnonzero(out == _BREAK)
    return out, np.append(breaks[:: ORDER - 1], len(out))


def gram_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that ends at each place (breaks count as blanks)."""
    points = np.where(points == _BREAK, np.uint64(_BLANK), points)
    h = points * _FACTORS[0]
    for j in range(1, n):
        h[j:] += points[:-j] * _FACTORS[j]
    return mix(h)


class HashRows:
    """A sorted array of hashes; find() gives the row of each hash, or -1."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(1, int(len(keys) * 2).bit_length())
        self.starts = np.searchsorted(keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        row = np.full(len(h), -1, np.int32)
        if not len(self.keys):
            return row
        at = self.starts[h >> np.uint64(64 - self.bits)]
        todo = np.arange(len(h), dtype=np.int32)
        want = h
        last = len(self.keys) - 1
        while len(todo):
            key = self.keys[np.minimum(at, last)]
            hit = (key == want) & (at <= last)
            row[todo[hit]] = at[hit]
            more = (key < want) & (at <= last)
            todo, want, at = todo[more], want[more], at[more] + 1
        return row


@dataclass
class Models:
    languages: list[str]
    grams: list[HashRows]
    logp: list[np.ndarray]
    contexts: list[HashRows]
    backoff: list[np.ndarray]
    floor: np.ndarray
    mean: np.ndarray | None = None
    per_doc: np.ndarray | None = None
    per_char: np.ndarray | None = None

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(nats per character of each text under each language, characters of each text)."""
        points, firsts = normalised(texts)
        real = np.flatnonzero(points != _BREAK)
        total = np.zeros((len(texts), len(self.languages)))
        counts = np.diff(np.searchsorted(real, firsts))
        if not len(real) or not self.languages:
            return total, counts
        logp = np.zeros((len(real), len(self.languages)), np.float32)
        todo = np.arange(len(real))
        for n in range(ORDER, 0, -1):
            row = self.grams[n - 1].find(gram_hashes(points, n)[real[todo]])
            hit = row >= 0
            logp[todo[hit]] += self.logp[n - 1][row[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
            if n > 1:
                row = self.contexts[n - 1].find(gram_hashes(points, n - 1)[real[todo] - 1])
                hit = row >= 0
                logp[todo[hit]] += self.backoff[n - 1][row[hit]]
        else:
            logp[todo] += self.floor
        full = counts > 0
        places = np.concatenate([[0], np.cumsum(counts)])[:-1][full]
        total[full] = -np.add.reduceat(logp.astype(np.float64), places, axis=0) / counts[full, None]
        return total, counts

    def rejects(self, language: np.ndarray, entropy: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.zeros(len(language), bool)
        sd = np.sqrt(self.per_doc[language] + self.per_char[language] / np.maximum(counts, 1))
        return entropy > self.mean[language] + np.maximum(REJECT_NATS, REJECT_SD * sd)


def _by_group(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, sums, rows of each)."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(inverse, values), np.bincount(inverse)


def fit(languages: list[str], of: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> Models:
    """Models from distinct 4-grams: language of each, its code points (oldest first) and its count."""
    vocabulary = max(2, len(np.unique(grams)) + 1)
    per: list[dict[int, tuple]] = []
    for lang in range(len(languages)):
        own, n = grams[of == lang], counts[of == lang].astype(float)
        orders = {}
        for k in range(ORDER, 0, -1):
            hashed = lambda g: mix((g.astype(np.uint64) * _FACTORS[: g.shape[1]][::-1]).sum(1, dtype=np.uint64))
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            context = hashed(own[:, :-1]) if k > 1 else np.zeros(len(own), np.uint64)
            ctx, total, kinds = _by_group(context, n)
            orders[k] = (own, hashed(own), n, context, ctx, total, discount * kinds / total, discount)
            if k > 1:  # a shorter gram counts the distinct characters before it
                own, inverse = np.unique(own[:, 1:], axis=0, return_inverse=True)
                n = np.bincount(inverse.reshape(-1)).astype(float)
        per.append(orders)
    m = Models(languages, [], [], [], [], np.zeros(len(languages), np.float32))
    lower_keys: np.ndarray = np.zeros(0, np.uint64)
    lower_p: np.ndarray = np.zeros((0, len(languages)))
    for k in range(1, ORDER + 1):
        every = np.concatenate([o[k][0] for o in per])
        keys, first = np.unique(np.concatenate([o[k][1] for o in per]), return_index=True)
        every = every[first]
        hashed = lambda g: mix((g.astype(np.uint64) * _FACTORS[: g.shape[1]][::-1]).sum(1, dtype=np.uint64))
        context = hashed(every[:, :-1]) if k > 1 else np.zeros(len(every), np.uint64)
        ctxs = np.unique(np.concatenate([o[k][4] for o in per]))
        back = np.ones((len(ctxs), len(languages)))
        p = np.zeros((len(keys), len(languages)))
        for lang, o in enumerate(per):
            _, own_keys, n, own_context, ctx, total, left, discount = o[k]
            back[np.searchsorted(ctxs, ctx), lang] = left
            p[np.searchsorted(keys, own_keys), lang] = np.maximum(n - discount, 0) / total[np.searchsorted(ctx, own_context)]
        share = back[np.searchsorted(ctxs, context)]
        if k == 1:
            m.floor = np.log(back[0] / vocabulary).astype(np.float32)
            below = np.full((len(keys), len(languages)), 1 / vocabulary)
        else:
            below = lower_p[np.searchsorted(lower_keys, hashed(every[:, 1:]))]
        p = p + share * below
        m.grams.append(HashRows(keys))
        m.logp.append(np.log(p).astype(np.float32))
        m.contexts.append(HashRows(ctxs))
        m.backoff.append(np.log(np.maximum(back, 1e-12)).astype(np.float32))
        lower_keys, lower_p = keys, p
    return m


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[str]]]:
    """Labels and texts, a piece at a time."""
    for batch in batches:
        for at, to, _, _ in pieces(batch.column(1)):
            yield batch.column(0).slice(at, to - at).to_pylist(), batch.column(1).slice(at, to - at).to_pylist()


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, grams as four columns, n), summed over a task."""
    held: dict[str, dict[bytes, int]] = {}
    for langs, texts in _small(batches):
        for lang in set(langs):
            points, _ = normalised([t for t, x in zip(texts, langs) if x == lang])
            real = np.flatnonzero(points != _BREAK)
            points = np.where(points == _BREAK, _BLANK, points).astype(np.uint32)
            rows = np.stack([points[real - j] for j in range(ORDER - 1, -1, -1)], axis=1)
            own = held.setdefault(lang, {})
            distinct, n = np.unique(np.ascontiguousarray(rows).view(f"V{4 * ORDER}").reshape(-1), return_counts=True)
            for gram, k in zip(distinct.tolist(), n.tolist()):
                own[gram] = own.get(gram, 0) + k
    for lang, own in held.items():
        rows = np.frombuffer(b"".join(own), np.uint32).reshape(-1, ORDER)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), *[pa.array(rows[:, j].astype(np.int32)) for j in range(ORDER)], pa.array(list(own.values()), pa.int64())], ["lang", *[f"g{j}" for j in range(ORDER)], "n"])


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Models:
    """Models from labelled (doc_id, text, lang); null texts or labels teach nothing."""
    labelled = labelled.where("text is not null and lang is not null")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("docs"))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("draw")), F.lit(1_000_003))
    drawn = labelled.join(F.broadcast(sizes), "lang").where(draw * F.col("docs") < F.lit(sample_docs * 1_000_003))  # one row per language
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("part")), F.lit(CALIBRATE))
    names = ", ".join(f"g{j} int" for j in range(ORDER))
    grams = map_batches(drawn.where(part != 0).select("lang", "text"), _count_grams, f"lang string, {names}, n bigint")
    got = grams.groupBy("lang", *[f"g{j}" for j in range(ORDER)]).agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(got["lang"].to_pylist()))
    if not languages:
        return Models([], [], [], [], [], np.zeros(0, np.float32))
    of = np.searchsorted(np.array(languages), got["lang"].to_numpy())
    models = fit(languages, of, np.stack([got[f"g{j}"].to_numpy() for j in range(ORDER)], axis=1), got["n"].to_numpy())

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _small(batches):
            entropy, n = models.cross_entropies(texts)
            at = np.searchsorted(np.array(languages), np.array(langs, dtype=object).astype(str))
            ok = (n > 0) & (at < len(languages))
            ok &= np.array(languages)[np.minimum(at, len(languages) - 1)] == np.array(langs, dtype=object)
            yield pa.RecordBatch.from_arrays([pa.array(at[ok]), pa.array(entropy[ok, at[ok]]), pa.array(n[ok])], ["lang", "entropy", "n"])

    held = map_batches(drawn.where(part == 0).select("lang", "text"), measure, "lang bigint, entropy double, n bigint").toArrow()
    at, entropy, n = (held[c].to_numpy() for c in ("lang", "entropy", "n"))
    if not len(at):
        return models
    models.mean, models.per_doc, models.per_char = (np.zeros(len(languages)) for _ in range(3))
    for lang in range(len(languages)):
        own = at == lang if (at == lang).sum() >= 20 else at >= 0
        models.mean[lang] = np.median(entropy[own])
        off = (entropy[own] - models.mean[lang]) ** 2
        fitted = np.linalg.lstsq(np.stack([np.ones(own.sum()), 1 / n[own]], axis=1), off, rcond=None)[0]
        models.per_doc[lang], models.per_char[lang] = max(fitted[0], 1e-4), max(fitted[1], 1e-2)
    return models


def predict(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, lang_pred, score, entropy, rejected)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*models.languages, "und"], dtype=object)
        for batch in batches:
            for at, to, _, _ in pieces(batch.column(1)):
                entropy, n = models.cross_entropies(batch.column(1).slice(at, to - at).to_pylist())
                if models.languages:
                    best = entropy.argmin(axis=1)
                    least = entropy.min(axis=1)
                    score = 1 / np.exp(-SHARPNESS * (entropy - least[:, None])).sum(axis=1)
                    rejected = models.rejects(best, least, n) | (n == 0)
                else:
                    best, least, score, rejected = (np.zeros(to - at, x) for x in (int, float, float, bool))
                    n, rejected = np.zeros_like(n), ~rejected
                und = n == 0
                best = np.where(und, len(models.languages), best)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array(names[best].tolist(), pa.string()), pa.array(np.where(und, 0.0, np.round(score, 6))), pa.array(np.round(least, 6), mask=und), pa.array(rejected)],
                    ["doc_id", "lang_pred", "score", "entropy", "rejected"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, f"doc_id {kind}, lang_pred string, score double, entropy double, rejected boolean")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Learn from the documents whose id isn't held out, and predict all: predict() with held_out."""
    learn = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    got = predict(docs, train(learn, sample_docs))
    return got.withColumn("held_out", held_out(F.col("doc_id")))


def recognised(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """docs, whatever their columns, without the documents that the models reject.

    Defined results: null texts and texts without a letter go; if no labelled row exists, every text with a letter stays.
    """
    other = [c for c in docs.columns if c != text_col]
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in other]).alias("row"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, _, _ in pieces(batch.column(1)):
                own = batch.slice(at, to - at)
                entropy, n = models.cross_entropies(own.column(1).to_pylist())
                keep = n > 0
                if models.languages:
                    keep &= ~models.rejects(entropy.argmin(axis=1), entropy.min(axis=1), n)
                yield own.filter(pa.array(keep))

    kept = map_batches(whole, run, f"row {whole.schema['row'].dataType.simpleString()}, text string")
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])
