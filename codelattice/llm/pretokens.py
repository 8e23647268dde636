"""Splitting bytes into pre-tokens, and looking them up, a piece of a batch at a time.

Both patterns in use cut text at borders of runs: letters, numbers, white space, others. Their further
rules (a blank goes to the run after it, contractions, numbers one by one) move, add or drop single
borders, so all borders of a piece follow from array operations. Which characters are letters, numbers
and white space is asked of the library's own regular expressions, so that its Unicode version counts.

`Known` remembers what each pre-token stands for, by a 64-bit hash of its bytes; the bytes are kept and
compared on every hit, so results don't rest on hashes. Only new pre-tokens are handed, once for a
worker, to the code that merges them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .words import hash_spans, same_bytes

LETTER, NUMBER, OTHER, SPACE = range(4)
#: What the contraction patterns take after an apostrophe.
_SHORT = (b"s", b"t", b"m", b"d")
_LONG = (b"re", b"ve", b"ll")
#: The patterns that split() follows, with and without spaces.
WITH_SPACES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WITHOUT_SPACES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters of each class, as patterns of one character and of its opposite.
_CLASSES = ((LETTER, r"\p{L}", r"\P{L}"), (NUMBER, r"\p{N}", r"\P{N}"), (SPACE, r"\s", r"\S"))
_runs: dict[str, tuple[np.ndarray, np.ndarray]] = {}
_tables: dict[str, np.ndarray] = {}


def _ask(engine: str, every: str) -> np.ndarray:
    """The class of each code point, as the regular expressions of a library have it."""
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, one, other in _CLASSES:
        if engine == "tiktoken":
            import tiktoken

            own = tiktoken.Encoding("classes", pat_str=f"{one}+", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
            found = bytes(own.encode_ordinary(every)).decode()
        else:
            from tokenizers import Regex, normalizers

            found = normalizers.Replace(Regex(f"{other}+"), "").normalize_str(every)
        table[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
    return table


def class_runs(engine: str) -> tuple[np.ndarray, np.ndarray]:
    """(first code point of each run of one class, its class), for the library `tiktoken` or `tokenizers`; asked once, on the driver."""
    if engine not in _runs:
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        table = _ask(engine, every)
        first = np.flatnonzero(np.concatenate([[True], table[1:] != table[:-1]]))
        _runs[engine] = first, table[first]
    return _runs[engine]


def class_table(engine: str, runs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The class of every code point, from runs that came with a task; kept by the worker."""
    if engine not in _tables:
        first, kinds = runs
        _tables[engine] = np.repeat(kinds, np.diff(np.append(first, 0x110000)))
    return _tables[engine]


def byte_classes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of UTF-8 belongs to."""
    kinds = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        wide = np.concatenate([data, np.zeros(3, np.uint8)])
        b = [wide[lead + j].astype(np.int32) for j in range(4)]
        points = ((b[0] & 0x1F) << 6) | (b[1] & 0x3F)
        three, four = b[0] >= 0xE0, b[0] >= 0xF0
        points = np.where(three, ((b[0] & 0x0F) << 12) | ((b[1] & 0x3F) << 6) | (b[2] & 0x3F), points)
        points = np.where(four, ((b[0] & 0x07) << 18) | ((b[1] & 0x3F) << 12) | ((b[2] & 0x3F) << 6) | (b[3] & 0x3F), points)
        of = table[points]
        kinds[lead] = kinds[lead + 1] = of
        kinds[lead[three] + 2] = of[three]
        kinds[lead[four] + 3] = of[four]
    return kinds


def _contractions(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(runs that are an apostrophe with a contraction after it, letters that go to it)."""
    at = np.flatnonzero((kinds[:-1] == OTHER) & (ends[:-1] - starts[:-1] == 1) & (data[starts[:-1]] == 39) & (kinds[1:] == LETTER) & joined[1:])
    taken = np.zeros(len(at), np.int64)
    wide = np.concatenate([data, np.zeros(2, np.uint8)])
    one, two = wide[ends[at]], wide[ends[at] + 1]
    for p in _SHORT:
        taken[one == p[0]] = 1
    for p in _LONG:
        taken[(one == p[0]) & (two == p[1])] = 2
    return at[taken > 0], taken[taken > 0]


def split(data: np.ndarray, offsets: np.ndarray, spaces: bool, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte of each pre-token, its end, for each document the place of its first, and one more).

    The patterns are WITH_SPACES and WITHOUT_SPACES; table holds the class of every code point.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    byte_kinds = byte_classes(data, table)
    border = np.empty(len(data), bool)
    border[0] = True
    border[1:] = byte_kinds[1:] != byte_kinds[:-1]
    border[offsets[offsets < len(data)]] = True
    if not spaces:
        border |= (byte_kinds == NUMBER) & ((data & 0xC0) != 0x80)
    starts = np.flatnonzero(border)
    ends = np.append(starts[1:], len(data))
    kinds = byte_kinds[starts]
    new_doc = np.zeros(len(data) + 1, bool)
    new_doc[offsets] = True
    joined = ~new_doc[starts]  # to the run before, in one document
    if spaces:
        blank_before = np.zeros(len(starts), bool)
        blank_before[1:] = joined[1:] & (kinds[:-1] == SPACE) & (data[starts[1:] - 1] == 32)
        pure = starts.copy()
        at, taken = _contractions(data, starts, ends, kinds, joined)
        ok = ~blank_before[at]
        at, taken = at[ok], taken[ok]
        starts = starts - (blank_before & (kinds != SPACE))
        ends = ends.copy()
        ends[at] += taken
        starts[at + 1] += taken
        space = kinds == SPACE
        followed = np.zeros(len(starts), bool)
        followed[:-1] = space[:-1] & joined[1:]
        last = ends - 1
        for _ in range(2):  # of white space, no character has more than three bytes
            last = np.where(followed & ((data[np.maximum(last, 0)] & 0xC0) == 0x80), last - 1, last)
        single = followed & (data[last] != 32)
        ends_first = np.where(followed, last, ends)
        more = np.flatnonzero(single & (last > pure))
        starts = np.concatenate([starts, last[more]])
        ends = np.concatenate([np.where(single & (last == pure), ends, ends_first), ends[more]])
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
    else:
        at, taken = _contractions(data, starts, ends, kinds, joined)
        starts, ends = starts.copy(), ends.copy()
        ends[at] += taken
        starts[at + 1] += taken
        starts, ends = starts[kinds != SPACE], ends[kinds != SPACE]
    full = ends > starts
    starts, ends = starts[full], ends[full]
    return starts, ends, np.searchsorted(starts, offsets)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in vocabulary files of byte-level BPE."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


_LETTERS = byte_letters()


def in_letters(word: bytes) -> str:
    """A pre-token as the library's model takes it: a letter for each byte."""
    return word.decode("latin-1").translate(_LETTERS)


class _Table:
    """Hashes in order, with an index of their leading bits; the row that each stands for."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.rows = keys[order], rows[order]
        self.bits = max(4, int(len(keys)).bit_length())
        self.starts = np.searchsorted(self.keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        if not len(self.keys):
            return out
        at, last = self.starts[h >> np.uint64(64 - self.bits)], len(self.keys) - 1
        at = np.minimum(at, last)
        key = self.keys[at]
        hit = key == h
        out[hit] = self.rows[at[hit]]
        todo = np.flatnonzero((key < h) & (at < last))
        while len(todo):
            at_todo = at[todo] + 1
            at[todo] = at_todo
            key, want = self.keys[at_todo], h[todo]
            hit = key == want
            out[todo[hit]] = self.rows[at_todo[hit]]
            todo = todo[(key < want) & (at_todo < last)]
        return out


class Known:
    """What each pre-token stands for: a run of 32-bit values. learn(pre-tokens) gives those of new ones.

    New pre-tokens make a table of their own; tables of like size are merged, so that each pre-token is sorted a few times only.
    given: pre-tokens known from the start, with their values.
    """

    def __init__(self, learn: Callable[[list[bytes]], list[list[int]]], most: int, given: tuple[list[bytes], list[list[int]]] = ((), ())):
        self.learn, self.most, self.given = learn, most, given
        self._clear()

    def _clear(self) -> None:
        self.tables: list[_Table] = []
        self.n = self.used = self.bytes_used = 0
        self._first, self._values = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.uint32)
        self._at, self._bytes = np.zeros(1 << 12, np.int64), np.zeros(1 << 15, np.uint8)
        words, values = self.given
        if len(words):
            raw = np.frombuffer(b"".join(words), np.uint8)
            ends = np.cumsum([len(w) for w in words])
            self._add(hash_spans(raw, ends - [len(w) for w in words], ends), list(words), list(values))

    @property
    def first(self) -> np.ndarray:
        return self._first[: self.n + 1]

    @property
    def values(self) -> np.ndarray:
        return self._values[: self.used]

    def _add(self, keys: np.ndarray, words: list[bytes], got: list[list[int]]) -> None:
        """Words with their values; those beyond the keys are in no table."""
        sizes, lengths = np.fromiter(map(len, got), np.int64, len(got)), np.fromiter(map(len, words), np.int64, len(words))
        total, raw = int(sizes.sum()), np.frombuffer(b"".join(words), np.uint8)

        def room(x: np.ndarray, need: int) -> np.ndarray:
            return x if need <= len(x) else np.concatenate([x, np.zeros(max(len(x), need - len(x)), x.dtype)])

        self._first, self._at = room(self._first, self.n + len(words) + 1), room(self._at, self.n + len(words) + 1)
        self._values, self._bytes = room(self._values, self.used + total), room(self._bytes, self.bytes_used + len(raw))
        self._first[self.n + 1 : self.n + 1 + len(words)] = self.used + np.cumsum(sizes)
        self._at[self.n + 1 : self.n + 1 + len(words)] = self.bytes_used + np.cumsum(lengths)
        self._values[self.used : self.used + total] = np.fromiter((v for x in got for v in x), np.uint32, total)
        self._bytes[self.bytes_used : self.bytes_used + len(raw)] = raw
        if len(keys):
            table = _Table(keys, np.arange(self.n, self.n + len(keys)))
            while self.tables and len(self.tables[-1].keys) <= 2 * len(table.keys):
                last = self.tables.pop()
                table = _Table(np.concatenate([last.keys, table.keys]), np.concatenate([last.rows, table.rows]))
            self.tables.append(table)
        self.n += len(words)
        self.used += total
        self.bytes_used += len(raw)

    def _other(self, row: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places whose bytes are not those of the row that their hash led to."""
        n = ends - starts
        differ = n != self._at[row + 1] - self._at[row]
        check = np.flatnonzero((n >= 8) & ~differ)  # shorter ones have hashes of their own
        differ[check] = ~same_bytes(data, starts[check], self._bytes, self._at[row[check]], n[check])
        return np.flatnonzero(differ)

    def rows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.n > self.most:
            self._clear()
        h = hash_spans(data, starts, ends)
        row = np.full(len(h), -1, np.int32)
        miss = np.arange(len(h))
        for table in self.tables:
            row[miss] = table.find(h[miss] if len(miss) < len(h) else h)
            miss = miss[row[miss] < 0]
            if not len(miss):
                break
        raw = data.tobytes() if len(miss) else b""
        if len(miss):
            keys, first, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            words = [raw[a:b] for a, b in zip(starts[miss[first]].tolist(), ends[miss[first]].tolist())]
            row[miss] = self.n + inverse
            self._add(keys, words, self.learn(words))
        other = self._other(row, data, starts, ends)
        if len(other):  # another pre-token has this hash: these are learnt anew, in no table
            words = [data[a:b].tobytes() for a, b in zip(starts[other].tolist(), ends[other].tolist())]
            new = sorted(set(words))
            at = dict(zip(new, range(self.n, self.n + len(new))))
            row[other] = [at[w] for w in words]
            self._add(np.zeros(0, np.uint64), new, self.learn(new))
        return row

    def expand(self, row: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of all pre-tokens in order, for each document the place of its first, and one more)."""
        n = self.first[row + 1] - self.first[row]
        at = np.concatenate([[0], np.cumsum(n)])
        values = self.values[np.repeat(self.first[row] - at[:-1], n) + np.arange(at[-1])]
        return values, at[firsts]
