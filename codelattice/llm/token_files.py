"""Token ids in files coded by a static range asymmetric numeral system.

One frequency table, counted over all documents, is shared by all blocks. A block holds whole
documents, in order of their id, and is coded on its own: symbol i goes to lane i % LANES, the lanes
share one stream of 32-bit words, and every CHECKPOINT steps the lanes' states and the place in the
stream are kept, so that parts of a block can be decoded side by side. Blocks carry a CRC-32 of
their bytes and one of their ids; both are checked on reading.

The container is Parquet, one row per block: Spark's own writer commits it, so it works in any store
and a lost executor leaves nothing half-written. Block layout (little-endian): magic, symbols, lanes,
words, checkpoints (5 unsigned 32-bit integers), the lanes' final states (64 bits each), checkpoints
(step, place: 32 bits each, then states), and the words.

Defined results: a null text is empty, so only the end id stands for it; rows with one id follow each
other in the order of their ids' bytes; null ids come first; an empty table gives an empty one.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import REMEMBERED
from .frames import drop_stored, map_batches, stored
from .pretokens import Known, class_runs, class_table, in_letters, split
from .words import pieces

MAGIC = 0x31534E52
BITS = 18
LANES = 512
CHECKPOINT = 128
BLOCK = 1 << 17
_LOW = np.uint64(1 << 31)
_U = np.uint64


def shared_table(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**BITS, at least 1 for every symbol that occurs."""
    occurs = counts > 0
    if occurs.sum() > 1 << BITS:
        raise ValueError("more symbols than the table has room for")
    out = np.zeros(len(counts), np.int64)
    if not occurs.any():
        return out
    out[occurs] = np.maximum(1, np.floor(counts[occurs] / counts.sum() * (1 << BITS))).astype(np.int64)
    over = int(out.sum()) - (1 << BITS)
    for s in np.argsort(-out, kind="stable"):
        if over == 0:
            break
        step = min(over, int(out[s]) - 1) if over > 0 else over
        out[s] -= step
        over -= step
    return out


class Coder:
    def __init__(self, table: np.ndarray):
        self.f = table.astype(np.uint64)
        self.c = np.concatenate([[0], np.cumsum(table)[:-1]]).astype(np.uint64)
        self.symbol_at = np.repeat(np.arange(len(table), dtype=np.uint32), table)

    def encode(self, ids: np.ndarray) -> bytes:
        lanes = min(LANES, max(1, len(ids)))
        state = np.full(lanes, _LOW, np.uint64)
        words: list[np.ndarray] = []
        marks: list[tuple[int, int, bytes]] = []
        steps, written = -(-len(ids) // lanes), 0
        for step in range(steps - 1, -1, -1):
            some = ids[step * lanes : (step + 1) * lanes]
            f, x = self.f[some], state[: len(some)]
            full = x >= f << _U(63 - BITS)
            if full.any():
                words.append((x[full] & _U(0xFFFFFFFF)).astype("<u4"))
                written += len(words[-1])
                x[full] >>= _U(32)
            q = x // f
            state[: len(some)] = (q << _U(BITS)) + (x - q * f) + self.c[some]
            if step and step % CHECKPOINT == 0:
                marks.append((step, written, state.astype("<u8").tobytes()))
        head = struct.pack("<5I", MAGIC, len(ids), lanes, written, len(marks)) + state.astype("<u8").tobytes()
        return head + b"".join(struct.pack("<2I", step, written - at) + kept for step, at, kept in reversed(marks)) + b"".join(w.tobytes() for w in reversed(words))

    def decode(self, block: bytes, part: int | None = None) -> np.ndarray:
        """The ids of a block, or only those between two checkpoints (part 0 is the first)."""
        magic, n, lanes, written, marks = struct.unpack_from("<5I", block)
        if magic != MAGIC:
            raise ValueError("not a block of this format")
        steps, at = -(-n // lanes), 20 + 8 * lanes
        starts = [(0, 0, 20)] + [(*struct.unpack_from("<2I", block, at + k * (8 + 8 * lanes)), at + k * (8 + 8 * lanes) + 8) for k in range(marks)]
        words = np.frombuffer(block, "<u4", written, at + marks * (8 + 8 * lanes)).astype(np.uint64)
        step, place, kept = starts[part or 0]
        stop = steps if part is None or part + 1 == len(starts) else starts[part + 1][0]
        state = np.frombuffer(block, "<u8", lanes, kept).astype(np.uint64)
        first, last = step * lanes, min(n, stop * lanes)
        out = np.empty(last - first, np.uint32)
        mask = _U((1 << BITS) - 1)
        for s in range(step, stop):
            m = min(lanes, n - s * lanes)
            x = state[:m]
            slot = x & mask
            ids = self.symbol_at[slot]
            out[s * lanes - first : s * lanes - first + m] = ids
            x = self.f[ids] * (x >> _U(BITS)) + slot - self.c[ids]
            low = np.flatnonzero(x < _LOW)
            if len(low):
                x[low] = (x[low] << _U(32)) | words[place : place + len(low)]
                place += len(low)
            state[:m] = x
        return out


_libraries: dict[str, tuple] = {}


def _library(path: str):
    """(tokenizer, splitter of its special strings, their ids, known pre-tokens)."""
    if path not in _libraries:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t = Tokenizer.from_file(path)
        special = {a.content.encode(): i for i, a in t.get_added_tokens_decoder().items()}
        cut = re.compile(b"|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        tokenize = t.model.tokenize
        learn = lambda words: [[x.id for x in tokenize(in_letters(w))] for w in words]
        _libraries[path] = (t, cut, special, Known(learn, REMEMBERED))
    return _libraries[path]


def _ids(data: np.ndarray, offsets: np.ndarray, path: str, table: np.ndarray) -> list[np.ndarray]:
    """The ids of each text of a piece; special strings are cut out before the rest is split."""
    _, cut, special, known = _library(path)
    found = [(m.start(), m.end(), special[m[0]]) for m in cut.finditer(data.tobytes())] if cut else []
    found = [x for x in found if np.searchsorted(offsets, x[0], side="right") == np.searchsorted(offsets, x[1] - 1, side="right")]
    if not found:
        starts, ends, firsts = split(data, offsets, True, table)
        values, places = known.expand(known.rows(data, starts, ends), firsts)
        return [values[a:b] for a, b in itertools.pairwise(places.tolist())]
    at, to, ids = (np.array(x, np.int64) for x in zip(*found))
    borders = np.unique(np.concatenate([offsets, at, to]))
    starts, ends, firsts = split(data, borders, True, table)
    values, places = known.expand(known.rows(data, starts, ends), firsts)
    parts = {int(b): values[places[k] : places[k + 1]] for k, b in enumerate(borders[:-1])}
    parts.update({int(b): np.array([i], np.uint32) for b, i in zip(at, ids)})
    out = []
    for a, b in itertools.pairwise(offsets.tolist()):
        own = borders[np.searchsorted(borders, a) : np.searchsorted(borders, b)].tolist() if b > a else []
        out.append(np.concatenate([parts[x] for x in own]) if own else np.zeros(0, np.uint32))
    return out


def token_ids(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, ids): ids as packed 16-bit integers with the end id, by the byte-level file at path.

    Each distinct pre-token that a worker meets is encoded by the library once. The file must split texts as split() does.
    """
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    by = told["pre_tokenizer"] or {}
    if told["normalizer"] is not None or (by.get("type"), by.get("add_prefix_space"), by.get("use_regex")) != ("ByteLevel", False, True):
        raise ValueError("the file splits text in another way")
    runs = class_runs("tokenizers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _library(path)[0].get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        end, table = np.array([end_id], "<u2").tobytes(), class_table("tokenizers", runs)
        for batch in batches:
            for at, to, data, offsets in pieces(batch.column(1)):
                ids = [x.astype("<u2").tobytes() + end for x in _ids(data, offsets, path, table)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, f"doc_id {kind}, n bigint, ids binary")


def symbol_counts(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all documents; at most a row per id and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                n += np.bincount(np.frombuffer(ids.as_buffer(), "<u2"), minlength=vocabulary)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["id", "n"])

    rows = map_batches(tokens.select("ids"), run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(vocabulary, np.int64)
    for r in rows:  # a row per symbol of the vocabulary at most
        out[r["id"]] = r["n"]
    return out


def write_blocks(tokens: DataFrame, table: np.ndarray, kind: str) -> DataFrame:
    """The blocks of all documents, in shards by ranges of doc_id, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, shard = Coder(table), TaskContext.get().partitionId()
        held, ids, size, before, block = [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            symbols = np.concatenate(ids).astype(np.uint32)
            data = coder.encode(symbols)
            docs = pa.array([[{"doc_id": d, "n": n} for d, n in held]], pa.list_(pa.struct([("doc_id", pa.int64()), ("n", pa.int64())])))
            sums = [zlib.crc32(data), zlib.crc32(symbols.astype("<u4").tobytes())]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, block, before, size)] + [docs, pa.array([data], pa.binary())] + [pa.array([x], pa.int64()) for x in sums], ["shard", "block", "before", "n", "docs", "data", "data_crc32", "ids_crc32"])

        for batch in batches:
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(np.frombuffer(x.as_buffer(), "<u2"))
                held.append((d, len(ids[-1])))
                size += len(ids[-1])
                if size >= BLOCK:
                    yield close()
                    held, ids, before, block, size = [], [], before + size, block + 1, 0
        if held:
            yield close()

    ordered = tokens.select("doc_id", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    return stored(map_batches(ordered, run, f"shard bigint, block bigint, before bigint, n bigint, docs array<struct<doc_id:{kind},n:bigint>>, data binary, data_crc32 bigint, ids_crc32 bigint"), "token-blocks")


def read_blocks(blocks: DataFrame, table: np.ndarray, kind: str, keep_ids: bool = False) -> DataFrame:
    """(shard, doc_id, before, n, ids_crc32[, ids]) of each document; `before` counts inside its shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(table)
        for batch in batches:
            for shard, before, docs, data, data_crc, ids_crc in zip(*(batch.column(i) for i in range(6))):
                data = data.as_py()
                if zlib.crc32(data) != data_crc.as_py():
                    raise ValueError(f"block of shard {shard} is damaged")
                ids = coder.decode(data).astype("<u4")
                if zlib.crc32(ids.tobytes()) != ids_crc.as_py():
                    raise ValueError(f"block of shard {shard} decodes to other ids")
                docs = docs.as_py()
                n = np.array([d["n"] for d in docs], np.int64)
                ends = np.cumsum(n)
                parts = [ids[e - k : e].tobytes() for e, k in zip(ends, n)]
                made = [pa.array([shard.as_py()] * len(n), pa.int64()), pa.array([d["doc_id"] for d in docs], pa.int64()), pa.array(before.as_py() + ends - n), pa.array(n), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                names = ["shard", "doc_id", "before", "n", "ids_crc32"]
                if keep_ids:
                    made.append(pa.array(parts, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(made, names)

    rows = blocks.select("shard", "before", "docs", "data", "data_crc32", "ids_crc32")
    return map_batches(rows, run, f"shard bigint, doc_id {kind}, before bigint, n bigint, ids_crc32 bigint" + ", ids binary" * keep_ids)


def write_and_read(docs: DataFrame, path: str, end_id: int = 0, vocabulary: int = 50257, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Tokenise, write in order of doc_id, and read back: (doc_id, start, n_tokens, ids_crc32[, ids])."""
    kind = "bigint"
    rows = docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.col(text_col).alias("text"))
    tokens = stored(token_ids(rows, path, end_id, "doc_id", "text"), "token-ids")
    table = shared_table(symbol_counts(tokens, vocabulary))
    blocks = write_blocks(tokens, table, kind)
    drop_stored(tokens)
    starts, at = [], 0
    for r in blocks.groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect():  # a row per shard
        starts.append((r["shard"], at))
        at += r["n"]
    spark = docs.sparkSession
    shards = spark.createDataFrame(starts, "shard bigint, first bigint")
    got = read_blocks(blocks, table, kind, keep_ids).join(F.broadcast(shards), "shard")
    return got.select("doc_id", (F.col("first") + F.col("before")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32", *["ids"] * keep_ids)
