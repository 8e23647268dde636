"""Token counts by the whole-token shortcut.

Before any text is read, the driver has the library encode every vocabulary string that can stand alone
as a pre-token; those that give exactly one token are the proven whole tokens. The proof goes to the
workers with the tasks. A text is split as the library splits it, pre-tokens that are proven whole
tokens count 1 each by one look-up, and only the rest is merged by the library, once for each
distinct pre-token that a worker meets.

The file's special strings inside a text are taken out first and count 1 each, as the library does
by default. Text is lower-cased and composed (NFC) as the file's normaliser says. Where a text has a
character that Python may compose or lower in another way than the library, the library itself splits
it; which characters these are follows from a comparison of both, beside blocks that Unicode extends.

Defined results: a null text is empty; an empty text has 0 bytes and 0 tokens; texts of any length
are counted whole; an empty table gives an empty one.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import REMEMBERED
from .frames import map_batches
from .pretokens import WITHOUT_SPACES, Known, byte_letters, class_runs, class_table, in_letters, split
from .words import pieces

#: Blocks beyond the older ones, where some Unicode version has more characters than another; the library splits them.
_NEWER = "ࡰ-࢟Ⰰ-⹿Ɤ-ꟿ\U00010000-\U0010ffff"


def normal(text: str) -> str:
    """Composed and lowered as the library does, but for white space and the characters of odd_characters()."""
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()  # the library lowers each sigma alone


def odd_characters(normalise) -> str:
    """The inside of a regular expression class: characters that the library normalises in another way, alone or among marks."""
    odd = []
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x10000))):
        alone = normalise(c) != normal(c) and not c.isspace()
        if alone or (unicodedata.category(c) in ("Mn", "Mc", "Cn") and normalise(f"aͅ{c}̖") != normal(f"aͅ{c}̖")):
            odd.append(c)
    return _NEWER + "".join(odd)


@dataclass(frozen=True)
class Proof:
    """What is found out of a file before any text is read."""

    whole: list[bytes]
    odd: str


_proofs: dict[tuple, Proof] = {}


def _library(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


def prove(path: str) -> Proof:
    """The strings of the vocabulary that encode alone as one token, in order; kept as long as the file is the same."""
    key = (path, os.stat(path).st_mtime_ns, os.stat(path).st_size)
    if key not in _proofs:
        library, of, strings = _library(path), {c: b for b, c in byte_letters().items()}, set()
        for token in library.get_vocab(with_added_tokens=False):
            try:
                word = bytes(of[c] for c in token.removesuffix("</w>")).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if word and word == word.lower():
                strings.add(word)
        ordered = sorted(strings)
        whole = [w.encode() for w, e in zip(ordered, library.encode_batch(ordered, add_special_tokens=False)) if len(e.ids) == 1]
        _proofs[key] = Proof(whole, odd_characters(library.normalizer.normalize_str))
    return _proofs[key]


class WordCounter:
    def __init__(self, path: str, proof: Proof, table: np.ndarray):
        from tokenizers import Regex, pre_tokenizers

        self.library, self.table = _library(path), table
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.special = [t["content"] for t in told["added_tokens"]]
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        pattern = told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if pattern != WITHOUT_SPACES:
            raise ValueError("the file splits text by another pattern")
        self.by_library = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.odd = re.compile(f"[{proof.odd}]")
        self.known = Known(self._merge, REMEMBERED, (proof.whole, [[1]] * len(proof.whole)))

    def _merge(self, words: list[bytes]) -> list[list[int]]:
        """How many tokens the library's merges leave of each pre-token."""
        tokenize = self.library.model.tokenize
        return [[len(tokenize(in_letters(w)))] for w in words]

    def counts(self, texts: list[str]) -> np.ndarray:
        total = np.zeros(len(texts), np.int64)
        parts: list[str] = []
        of: list[int] = []
        for i, text in enumerate(texts):
            if self.specials and self.specials.search(text):
                cut = self.specials.split(text)
                total[i] += len(cut) - 1
            else:
                cut = [text]
            for part in cut:
                if not part.isascii() and self.odd.search(part):
                    words = [w.encode() for w, _ in self.by_library.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
                    total[i] += sum(n for (n,) in self._merge(words))
                else:
                    parts.append(normal(part))
                    of.append(i)
        raw = [p.encode() for p in parts]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        starts, ends, firsts = split(data, offsets, False, self.table)
        rows = self.known.rows(data, starts, ends)
        sums = np.concatenate([[0], np.cumsum(self.known.values[self.known.first[rows]].astype(np.int64))])
        np.add.at(total, np.array(of, np.int64), sums[firsts[1:]] - sums[firsts[:-1]])
        return total


_counters: dict[str, WordCounter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, n_bytes, n_tokens, over_limit)."""
    proof, runs = docs.sparkSession.sparkContext.broadcast(prove(path)), class_runs("tokenizers")  # as large as the vocabulary at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = WordCounter(path, proof.value, class_table("tokenizers", runs))
        counter = _counters[path]
        for batch in batches:
            for at, to, _, offsets in pieces(batch.column(1)):
                texts = [t or "" for t in batch.column(1).slice(at, to - at).to_pylist()]
                n = counter.counts(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array(offsets[1:] - offsets[:-1]), pa.array(n), pa.array(n > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
