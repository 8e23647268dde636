"""Repeated passages by a sparse suffix array.

Suffixes are kept only where their text asks for it: among any W consecutive k-word grams the one with
the least hash is chosen (minimisers, k + W - 1 = MIN_WORDS), so every window of MIN_WORDS words
has a chosen place, the same one wherever it stands. Places whose gram is unique in the
corpus are dropped after one combining count; the others fetch the words around them (as 64-bit hashes under a key
out of all texts, so that nobody can write words that collide, and serial numbers don't),
as many to each side as a window with this place can have. These suffixes are sorted over the
whole cluster by range (gram, words to the right, words to the left, document, place), and neighbours are
compared: equal ones form a class, of which the first row speaks for all, and the words that a class has in
common with its neighbours to the right bound the windows that it can share. Within a gram, each match is
then extended to the left and right, to the windows that chose the gram: of each window that comes twice or
more, the least document and place is its first place.

The words of a window's first place stay. Words that lie in other places of repeated windows, and in no first
place, are repeats; so whatever is cut stands whole somewhere else. Longer passages have a chosen place
every W words at least, and their windows unite.

Sorting by the whole context deals a passage that very many documents share to as many tasks as its rows
need. Grams that go on beyond a task, or have more than GROUP_ROWS rows in one, hand their windows to an
aggregate that combines before it shuffles; there is no limit to any group.

Defined results: null and blank texts and texts of fewer than MIN_WORDS words have no passages; a
passage that comes twice in one text counts as repeated too; where a word belongs to a passage's first
place and to the repeat of another, it stays; rows are told apart by id and text, and rows that agree in both
are one document; rows without an id are left alone; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import corpus_key, cut, drop_stored, map_batches, stored
from .words import grams, mix, pieces, word_hashes

MIN_WORDS = 50
K = 25
W = MIN_WORDS - K + 1
#: Words to either side of a gram that a window with it can have.
REACH = MIN_WORDS - K
#: Rows of suffixes that are looked at together.
GROUP_ROWS = 16_384
_POSITION_BITS = 22  # of places in a piece when equal grams are told apart; longer pieces just tie
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def chosen(g: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the minimisers among the grams g of all documents of a piece, in order, and to their left the least and most words of the windows that chose them."""
    counts = np.diff(firsts)
    windows = np.maximum(counts - MIN_WORDS + 1, 0)
    if not windows.sum():
        return (np.zeros(0, np.int64),) * 3
    low = _U((1 << _POSITION_BITS) - 1)
    least = (g & ~low) | (np.arange(len(g), dtype=np.uint64) & low)
    place = np.arange(len(g))
    size = 1
    while size < W:  # windows of `size` grams become wider until they have W
        step = min(size, W - size)
        a, b = least[:-step], least[step:]
        place = np.where(b < a, place[step:], place[:-step])
        least = np.minimum(a, b)
        size += step
    at = np.concatenate([[0], np.cumsum(windows)])
    starts = np.repeat(firsts[:-1] - at[:-1], windows) + np.arange(at[-1])
    out, first, n = np.unique(place[starts], return_index=True, return_counts=True)
    most, least = out - starts[first], out - starts[first + n - 1]
    doc = np.searchsorted(firsts, out, side="right")
    same = np.zeros(len(out), bool)  # a text that repeats a few words over and over needs one place in W only
    same[1:] = (g[out[1:]] == g[out[:-1]]) & (doc[1:] == doc[:-1]) & (np.diff(out) < W)
    run = np.maximum.accumulate(np.where(same, 0, np.arange(len(out))))
    turn = (out - out[run]) // W
    keep = np.ones(len(out), bool)
    keep[1:] = ~same[1:] | (turn[1:] != turn[:-1])
    many = same | np.append(same[1:], False)
    return out[keep], np.where(many, 0, least)[keep], np.where(many, REACH, most)[keep]


def _choose(batches: Iterator[pa.RecordBatch], seed: int = 0) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, data, offsets in pieces(batch.column(1)):
            h, _, _, firsts = word_hashes(data, offsets, seed=seed)
            g = grams(h, K)
            out, least, most = chosen(g, firsts)
            doc = np.searchsorted(firsts, out, side="right") - 1
            own = [batch.column(c).slice(at, to - at).take(pa.array(doc)) for c in (0, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(g[out].view(np.int64)), *own, *(pa.array(x.astype(np.int32)) for x in (out - firsts[doc], least, most))], ["gram", "doc_id", "tie", "place", "least", "most"])


def _wide(x: np.ndarray) -> pa.Array:
    """The rows of a byte matrix as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(x))])


def _contexts(batches: Iterator[pa.RecordBatch], seed: int = 0) -> Iterator[pa.RecordBatch]:
    """The words around each place that is asked for; those beyond the text's ends are 0."""
    for batch in batches:
        places = batch.column(3)
        for at, to, data, offsets in pieces(batch.column(1)):
            h, _, _, firsts = word_hashes(data, offsets, seed=seed)
            g = grams(h, K)
            h[h == 0] = 1
            own = places.slice(at, to - at)
            n = np.array([len(x) for x in own], np.int64)
            flat = own.flatten()
            asked = flat.field("gram").to_numpy(zero_copy_only=False).view(np.uint64)
            doc = np.repeat(np.arange(to - at), n)
            place = flat.field("place").to_numpy(zero_copy_only=False).astype(np.int64) + firsts[doc]
            ok = place + K <= firsts[doc + 1]
            ok[ok] = g[place[ok]] == asked[ok]
            doc, place, asked = doc[ok], place[ok], asked[ok]
            step = np.arange(REACH)
            right = place[:, None] + K + step
            left = place[:, None] - 1 - step
            padded = np.append(h, _U(0))
            right = padded[np.where(right < firsts[doc + 1][:, None], right, len(h))]
            left = padded[np.where(left >= firsts[doc][:, None], left, len(h))]
            key = np.concatenate([asked.astype(">u8").view(np.uint8).reshape(len(doc), 8), right.astype(">u8").view(np.uint8).reshape(len(doc), 8 * REACH)], axis=1)
            left = left.astype(">u8").view(np.uint8).reshape(len(doc), 8 * REACH)
            ids = [batch.column(c).slice(at, to - at).take(pa.array(doc)) for c in (0, 2)]
            bounds = [flat.field(c).filter(pa.array(ok)) for c in ("least", "most")]
            if len(doc):
                yield pa.RecordBatch.from_arrays([_wide(key), _wide(left), *ids, pa.array((place - firsts[doc]).astype(np.int32)), *bounds], ["key", "left", "doc_id", "tie", "place", "least", "most"])


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _windows(gram: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of each window of MIN_WORDS words with the gram; column o has o words to its left."""

    def along(x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), REACH + 1), np.uint64)
        out[:, 0] = 1
        for d in range(REACH):
            out[:, d + 1] = mix(out[:, d] * _ODD + x[:, d])
        return out

    return mix(mix(along(left) ^ gram[:, None]) + along(right)[:, ::-1] * _ODD)


def _judge(key: np.ndarray, left: np.ndarray, ids: np.ndarray, ties: np.ndarray, place: np.ndarray, least_left: np.ndarray, most_left: np.ndarray, open_grams: set[int]) -> tuple[np.ndarray, ...]:
    """Spans (doc_id, tie, at, to, stays, first_doc, window, times) of sorted suffixes; whole grams, but for the open ones.

    Open grams give the windows of each class (stays is null): which is the first one is found out later.
    """
    gram = np.ascontiguousarray(key[:, :8]).view(">u8").reshape(-1).astype(np.uint64)
    right, left = (np.ascontiguousarray(x).view(">u8").astype(np.uint64) for x in (key[:, 8:], left))
    new_gram, new_class = np.ones(len(gram), bool), np.ones(len(gram), bool)
    new_gram[1:] = gram[1:] != gram[:-1]
    new_class[1:] = new_gram[1:] | (right[1:] != right[:-1]).any(axis=1) | (left[1:] != left[:-1]).any(axis=1)
    rep = np.flatnonzero(new_class)
    times = np.diff(np.append(rep, len(gram)))
    opened = np.isin(gram[rep], np.array(sorted(open_grams), np.uint64))
    alone = new_gram[rep] & np.append(new_gram[rep[1:]], True)  # the only class of its gram
    n_left, n_right = (left[rep] != 0).sum(axis=1), (right[rep] != 0).sum(axis=1)
    near = np.zeros(len(rep) + 1, np.int64)  # words to the right in common with the class before, if it has the same gram
    if len(rep) > 1:
        same = (right[rep[1:]] == right[rep[:-1]]) & (right[rep[1:]] != 0)
        near[1:-1] = np.where(new_gram[rep[1:]], 0, np.where(same.all(axis=1), REACH, same.argmin(axis=1)))
    edge = np.zeros(len(rep) + 1, bool)
    edge[0] = edge[-1] = True
    near[edge] = REACH  # what stands beyond is not known; where the gram is whole, the gram decides
    shared = np.maximum(near[:-1], near[1:])
    shared = np.where(alone & ~opened, 0, shared)
    look = np.flatnonzero(opened | ~alone | (times > 1))
    look = look[np.lexsort((place[rep[look]], ties[rep[look]], ids[rep[look]]))]  # so that the first of equal windows is the least place
    o = np.arange(REACH + 1)
    may = (o >= least_left[rep[look]][:, None]) & (o <= most_left[rep[look]][:, None])
    may &= (o <= n_left[look][:, None]) & (REACH - o <= n_right[look][:, None])
    may &= (REACH - o <= shared[look][:, None]) | (times[look] > 1)[:, None]
    who, off = np.nonzero(may)
    window = _windows(gram[rep[look]], left[rep[look]], right[rep[look]])[who, off]
    who = look[who]
    order = np.argsort(window, kind="stable")
    head = np.ones(len(order), bool)
    head[1:] = window[order[1:]] != window[order[:-1]]
    group = np.cumsum(head) - 1
    first = np.empty(len(order), np.int64)
    first[order] = order[np.flatnonzero(head)][group] if len(order) else first
    n = np.empty(len(order), np.int64)
    n[order] = np.bincount(group, times[who[order]]).astype(np.int64)[group] if len(order) else n
    stays = first == np.arange(len(order))
    later = opened[who]
    some = later | (n > 1)
    who, off, window, stays, later, source = (x[some] for x in (who, off, window, stays, later, ids[rep[who[first]]] if len(order) else ids[:0]))
    least = ids[rep].copy()
    np.minimum.at(least, who[~later], source[~later])
    # windows of one class that follow each other and have one verdict are one span
    cut_ = np.ones(len(who), bool)
    cut_[1:] = (who[1:] != who[:-1]) | (off[1:] != off[:-1] + 1) | (stays[1:] != stays[:-1]) | later[1:]
    heads = np.flatnonzero(cut_)
    tails = np.append(heads[1:], len(who)) - 1
    row = rep[who[heads]]
    begin, end = place[row] - off[tails], place[row] - off[heads] + MIN_WORDS
    found = [ids[row], ties[row], begin, end, np.where(later[heads], 2, stays[heads]), np.minimum.reduceat(source, heads) if len(heads) else source, np.where(later[heads], window[heads].view(np.int64), 0), times[who[heads]]]
    # the other rows of a class repeat its first one
    of = np.repeat(np.arange(len(rep)), times)
    other = np.flatnonzero(~new_class)
    other = other[(n_left + n_right)[of[other]] >= REACH]
    c = of[other]
    more = [ids[other], ties[other], place[other] - n_left[c], place[other] + K + n_right[c], np.zeros(len(other), np.int64), least[c], np.zeros(len(other), np.int64), np.ones(len(other), np.int64)]
    return tuple(np.concatenate([np.asarray(x, np.int64), np.asarray(y, np.int64)]) for x, y in zip(found, more))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the sorted suffixes of a task; grams that may go on in another task, or have too many rows here, are open."""
    held: list[tuple] = []
    n, open_grams = 0, set()
    number = lambda row: int.from_bytes(row[:8].tobytes(), "big")

    def judged(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, n
        rows = tuple(np.concatenate(x) for x in zip(*held))
        keep = np.ones(n, bool)  # a row that stands in the table twice is one place
        keep[1:] = (rows[0][1:] != rows[0][:-1]).any(axis=1) | (rows[1][1:] != rows[1][:-1]).any(axis=1) | np.any([x[1:] != x[:-1] for x in rows[2:5]], axis=0)
        rows = tuple(x[keep] for x in rows)
        grams_ = np.ascontiguousarray(rows[0][:, :8]).view(">u8").reshape(-1)
        start = int(np.searchsorted(grams_, grams_[-1]))  # of the last gram
        if last or not start:
            open_grams.add(number(rows[0][-1]))
            start = len(grams_)
        spans = _judge(*(x[:start] for x in rows), open_grams)
        if start < len(grams_):
            held = [tuple(x[start:] for x in rows)]
            open_grams.clear()
        else:
            held = []
        n = len(grams_) - start
        names = ["doc_id", "tie", "at", "to", "stays", "first_doc", "window", "times"]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in spans], names)

    for batch in batches:
        if batch.num_rows:
            key = _fixed(batch.column(0), 8 + 8 * REACH)
            if not n and not held and not open_grams:
                open_grams.add(number(key[0]))
            held.append((key, _fixed(batch.column(1), 8 * REACH), *(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(2, 7))))
            n += batch.num_rows
            if n >= GROUP_ROWS:
                yield from judged(last=False)
    if n:
        yield from judged(last=True)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of one document: repeats united, without the words that the document keeps for others."""
    for batch in batches:
        out: list[tuple] = []
        for i, tie, spans in zip(*(batch.column(c).to_pylist() for c in range(3))):
            n = max(s["to"] for s in spans) + 1
            holds, repeats = np.zeros(n, bool), np.zeros(n, bool)
            origin = np.full(n, np.iinfo(np.int64).max)
            for s in spans:
                (holds if s["stays"] else repeats)[s["at"] : s["to"]] = True
                if not s["stays"]:
                    np.minimum(origin[s["at"] : s["to"]], s["first_doc"], out=origin[s["at"] : s["to"]])
            for mask, stays in ((holds, True), (repeats & ~holds, False)):
                edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                out.extend((i, tie, a, b, stays, i if stays else int(origin[a:b].min())) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()))
        columns = list(zip(*out)) if out else [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], ["doc_id", "tie", "start_word", "end_word", "kept", "first_doc_id"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, tie) of the rows with an id, of rows that agree in id and text only one."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("tie")).where("doc_id is not null and text is not null")
    again = cut(rows.groupBy("doc_id", "tie").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "tie"))
    if not again.limit(1).count():
        return rows
    one = rows.join(again, ["doc_id", "tie"], "left_semi").groupBy("doc_id", "tie").agg(F.first("text").alias("text"))
    return rows.join(again, ["doc_id", "tie"], "left_anti").select("doc_id", "text", "tie").union(one.select("doc_id", "text", "tie"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage: (doc_id, tie, start_word, end_word, kept, first_doc_id).

    kept: a first place, which stays; first_doc_id: for a repeat, the least document known to hold what it repeats.
    Words are counted from 0, end_word is the one after the last. tie is xxhash64 of the text, which tells rows of one id apart.
    """
    rows, (seed, _) = _keyed(docs, id_col, text_col), corpus_key(docs, text_col)
    suffixes = stored(map_batches(rows, lambda b: _choose(b, seed), "gram bigint, doc_id bigint, tie bigint, place int, least int, most int"), "suffixes")
    # written out, so that the join deals both sides anew and may split a gram that very many documents share
    shared = stored(suffixes.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "shared-grams")
    asked = suffixes.join(shared, "gram").groupBy("doc_id", "tie").agg(F.collect_set(F.struct("gram", "place", "least", "most")).alias("places"))
    near = map_batches(rows.join(asked, ["doc_id", "tie"]).select("doc_id", "text", "tie", "places"), lambda b: _contexts(b, seed), "key binary, left binary, doc_id bigint, tie bigint, place int, least int, most int")
    near = stored(near, "contexts")
    drop_stored(suffixes, shared)
    order = ["key", "left", "doc_id", "tie", "place"]
    spans = map_batches(near.repartitionByRange(*order).sortWithinPartitions(*order), _compare, "doc_id bigint, tie bigint, at bigint, to bigint, stays bigint, first_doc bigint, window bigint, times bigint")
    spans = stored(spans, "spans")
    drop_stored(near)
    asked = spans.where("stays = 2")
    least = asked.groupBy("window").agg(F.min(F.struct("doc_id", "tie", "at")).alias("least"), F.sum("times").alias("n")).where("n > 1")
    own = F.struct("doc_id", "tie", "at") == F.col("least")
    settled = asked.join(least, "window").select("doc_id", "tie", F.struct("at", "to", own.alias("stays"), F.col("least.doc_id").alias("first_doc")).alias("span"))
    spans_ = spans.where("stays < 2").select("doc_id", "tie", F.struct("at", "to", (F.col("stays") == 1).alias("stays"), "first_doc").alias("span")).union(settled)
    got = map_batches(spans_.groupBy("doc_id", "tie").agg(F.collect_set("span").alias("spans")), _merge, "doc_id bigint, tie bigint, start_word bigint, end_word bigint, kept boolean, first_doc_id bigint")
    got = stored(got, "passages")
    drop_stored(spans)
    return got


def _cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, data, offsets in pieces(batch.column(1)):
            _, starts, _, firsts = word_hashes(data, offsets)
            texts = []
            for i, spans in enumerate(batch.column(2).slice(at, to - at).to_pylist()):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                own = np.append(starts[firsts[i] : firsts[i + 1]] - offsets[i], len(text)).tolist()
                parts, done = [], 0
                for a, b in sorted((s["start_word"], s["end_word"]) for s in spans or ()):
                    a, b = min(a, len(own) - 1), min(b, len(own) - 1)
                    parts.append(text[done : own[a]])
                    done = max(done, own[b])
                texts.append(b"".join([*parts, text[done:]]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(texts, pa.string())], ["row", "text"])


def without_repeats(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, whatever their columns, without the repeats among passages; a column n_chars follows the new text.

    Defined results: rows are matched by id and text; rows without an id or text, or without a repeat, stay as they
    are, but for texts without a word, which go, as do rows that are left without one.
    """
    spans = passages.where("not kept").groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"), F.col(text_col).alias("text"), F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tie"))
    marked = whole.join(spans, ["doc_id", "tie"], "left").select("row", "text", "spans")
    left = map_batches(marked, _cut_words, f"row {whole.schema['row'].dataType.simpleString()}, text string")
    left = left.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    columns = [F.col("text").alias(c) if c == text_col else F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns]
    return left.select(*columns)
