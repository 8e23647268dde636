"""Byte-level BPE encoding by backtracking over longest matches, and decoding.

The bytes of a pre-token become Latin-1 characters, so that an Aho-Corasick automaton over the
vocabulary finds, in one pass, every token that starts at every place. A sequence of tokens is what
the merges would give exactly if every two neighbours are compatible: merged on their own, the bytes
of both give these two tokens. So the longest match is taken at each place if it is compatible with
the token before it, else the next shorter one, else the walk steps back; a place from which no
way leads on is never tried again, which keeps the walk linear. Matches are held for a window of places, so memory
follows the text and its ids, not its matches. Compatibility is decided by walking
up the two edges of the border in the order in which merges would happen, and is memoised.

Defined results: a null text is empty and has no ids; any text, of any length, decodes to its own
bytes; repeated rows and other columns are left alone; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from array import array
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_batches
from .pretokens import WITH_SPACES, Known, class_runs, class_table, split
from .words import pieces

#: Pre-tokens that a worker remembers (some 50 MB); when they are full, it begins anew.
REMEMBERED = 1_000_000
#: Between pre-tokens that are searched together; no Latin-1 character.
_BETWEEN = "Ā"
_FAR = 1 << 60
#: Places whose matches are held at a time; longer pre-tokens are searched window by window.
WINDOW = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class _Matches:
    """The tokens that start at each place of a text, a window of places at a time: those left behind are searched again if the walk steps back."""

    def __init__(self, automaton: ahocorasick.Automaton, text: str, longest: int):
        self.automaton, self.text, self.longest = automaton, text, longest
        self.windows: dict[int, list[list[tuple[int, int]]]] = {}

    def at(self, place: int) -> list[tuple[int, int]]:
        number, own = divmod(place, WINDOW)
        if number not in self.windows:
            first = number * WINDOW
            found: list[list[tuple[int, int]]] = [[] for _ in range(min(WINDOW, len(self.text) - first))]
            for end, hit in self.automaton.iter(self.text, first, min(len(self.text), first + WINDOW + self.longest)):
                if end - hit[1] + 1 - first < len(found):
                    found[end - hit[1] + 1 - first].append(hit)
            for old in sorted(self.windows)[:-1]:  # this window and the one before it or after it are kept
                del self.windows[old]
            self.windows[number] = found
        return self.windows[number][own]


class BacktrackingBpe:
    """Encoder of single pre-tokens and decoder, over a table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.parts: dict[int, tuple[int, int] | None] = {}
        self._edges: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
        self._fits: dict[tuple[int, int], bool] = {}
        self.longest = max(map(len, ranks))
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            parts = self._last_merge(token)
            if parts is not None:
                self.parts[rank] = parts if len(token) > 1 else None
                self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()

    def _last_merge(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens merged last into token; None if merging its bytes doesn't end in it."""
        if len(token) == 1:
            return (0, 0)
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], _FAR), i) for i in range(len(parts) - 1))
            if rank == _FAR:
                return None
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if all(p in self.ranks for p in parts) else None

    def _edge(self, token: int, right: bool) -> list[int]:
        """The tokens that end (right) or begin token, from itself down to one byte."""
        known = self._edges[right]
        if token not in known:
            edge = [token]
            while (parts := self.parts[edge[-1]]) is not None:
                edge.append(parts[right])
            known[token] = edge
        return known[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges keep the border between the two tokens."""
        pair = (left, right)
        if pair not in self._fits:
            ends, begins, name, ranks = self._edge(left, True), self._edge(right, False), self.bytes_of, self.ranks
            i, j, ok = len(ends) - 1, len(begins) - 1, True
            while True:
                grown_left, grown_right = ends[i - 1] if i else _FAR, begins[j - 1] if j else _FAR
                across = ranks.get(name[ends[i]] + name[begins[j]], _FAR)
                if across < grown_left and across <= grown_right and across != _FAR:  # equal merges go from left to right
                    ok = False
                    break
                if grown_left == grown_right == _FAR:
                    break
                if grown_left <= grown_right:
                    i -= 1
                else:
                    j -= 1
            if len(self._fits) > 200_000:
                self._fits.clear()
            self._fits[pair] = ok
        return self._fits[pair]

    def encode_all(self, words: list[bytes]) -> list[Sequence[int]]:
        """The ids of each pre-token."""
        short = [w for w in words if len(w) <= WINDOW]
        matches = _Matches(self.automaton, _BETWEEN.join(w.decode("latin-1") for w in short), self.longest)
        out, at = [], 0
        for w in words:
            if len(w) > WINDOW:
                out.append(self._walk(_Matches(self.automaton, w.decode("latin-1"), self.longest), 0, len(w)))
                continue
            out.append(self._walk(matches, at, at + len(w)))
            at += len(w) + 1
        return out

    def _walk(self, matches: _Matches, start: int, end: int) -> Sequence[int]:
        ids = array("I")
        tried = array("H")  # how many of the matches at the start of ids[k] are left
        place, left, dead, fits = start, len(matches.at(start)) if start < end else 0, set(), self.fits
        while place < end:
            found = matches.at(place)
            while left:
                left -= 1
                token, n = found[left]
                if place + n not in dead and (not ids or fits(ids[-1], token)):
                    ids.append(token)
                    tried.append(left)
                    place += n
                    left = len(matches.at(place)) if place < end else 0
                    break
            else:
                if not ids:
                    raise ValueError("a byte has no token")
                dead.add(place)
                place -= len(self.bytes_of[ids.pop()])
                left = tried.pop()
        return ids.tolist() if end - start <= WINDOW else ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_encoders: dict[str, tuple[BacktrackingBpe, Known]] = {}


def encoder(path: str) -> tuple[BacktrackingBpe, Known]:
    """The encoder of a rank file, and the ids of the pre-tokens it met; kept by the worker."""
    if path not in _encoders:
        bpe = BacktrackingBpe(read_ranks(path))
        _encoders[path] = (bpe, Known(bpe.encode_all, REMEMBERED))
    return _encoders[path]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, pattern: str = WITH_SPACES) -> DataFrame:
    """One row per row of docs: (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]).

    path: a rank file that every executor can read; pattern: what cuts a text into pre-tokens, which must be the one that
    split() follows with spaces. ids (with keep_ids) are little-endian unsigned 32-bit integers, as in the first digest.
    """
    if pattern != WITH_SPACES:
        raise ValueError("texts are to be split by another pattern")
    runs = class_runs("tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = encoder(path)
        table = class_table("tiktoken", runs)
        for batch in batches:
            for at, to, data, offsets in pieces(batch.column(1)):
                starts, ends, firsts = split(data, offsets, True, table)
                values, places = known.expand(known.rows(data, starts, ends), firsts)
                ids = [values[a:b].astype("<u4").tobytes() for a, b in itertools.pairwise(places.tolist())]
                back = [hashlib.sha256(bpe.decode(np.frombuffer(x, "<u4").tolist())).hexdigest() for x in ids]
                made = [batch.column(0).slice(at, to - at), pa.array(np.diff(places)), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array(back, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    made.append(pa.array(ids, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(made, names)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids)


def merged_by_rank(ranks: dict[bytes, int], word: bytes) -> list[int]:
    """Plain merging, for tests: the lowest rank first, from left to right."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, i = min((ranks.get(a + b, _FAR), i) for i, (a, b) in enumerate(itertools.pairwise(parts)))
        if rank == _FAR:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]
