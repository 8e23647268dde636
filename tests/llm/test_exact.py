"""Texts made to break hashes, Unicode tables, ids and marks: the operators against brute force, plain versions and the libraries."""

import collections
import itertools
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from codelattice.llm import fingerprints as fp
from codelattice.llm import language_id, preferences, pretokens, quality, registry, suffix_dedup, token_counts, token_files, words
from codelattice.llm.bpe import BacktrackingBpe, encode_decode, encoder, read_ranks
from codelattice.llm.minhash import near_duplicates, without_near_duplicates

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def public(name):
    return pytest.importorskip("public_tokenizers").path(name)


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


@pytest.fixture(scope="module")
def colliding():
    """Words that any polynomial hash modulo 2**64 takes for equal, alone, in both orders and inside texts."""
    out = []
    for n in (1024, 2048):
        x, y = thue_morse(n), thue_morse(n, "ba")
        out += [x, y, f"x {x} y", f"x {y} y", f"{x} {y}", f"{y} {x}"]
    return out


def test_colliding_words_have_their_own_ids(spark, colliding):
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("tokenizers")
    import public_tokenizers

    df = spark.createDataFrame(list(enumerate(colliding)), "doc_id long, text string").coalesce(1)
    path = public("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    got = {r["doc_id"]: r for r in encode_decode(df, path, keep_ids=True).collect()}
    for i, x in enumerate(colliding):
        ids = np.frombuffer(bytes(got[i]["ids"]), "<u4").tolist()
        assert ids == library.encode_ordinary(x) and library.decode(ids) == x
    word, byte = (tokenizers.Tokenizer.from_file(public(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df, public("word_bpe_49k.json")).collect()}
    assert counts == {i: len(word.encode(x, add_special_tokens=False).ids) for i, x in enumerate(colliding)}
    files = {r["doc_id"]: r["ids_crc32"] for r in token_files.write_and_read(df, public("byte_bpe_50k.json")).collect()}
    assert files == {i: zlib.crc32(np.array([*byte.encode(x, add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, x in enumerate(colliding)}


def test_colliding_words_are_not_linked(spark, colliding):
    rows = near_duplicates(spark.createDataFrame(list(enumerate(colliding)), "doc_id long, text string")).collect()
    assert all(r["component_id"] == r["doc_id"] and r["kept"] for r in rows)


def forged_words():
    """Pairs of words of 16 letters that a chain of mix() with fixed factors takes for equal: the second half makes up for the first."""
    word = lambda x: int.from_bytes(x.encode(), "little")
    odd, out = 0x9E3779B97F4A7C15, []
    for first, other in (("myrbzvkf", "tkvgrlre"), ("abcdefgh", "hgfedcba"), ("qwertyui", "asdfghjk")):
        a, b = (int(words.mix(np.array([word(x)], np.uint64))[0]) for x in (first, other))
        tail = "ayjlwwrx"
        made = (word(tail) + (a - b) * odd) % 2**64
        out.append((first.encode() + tail.encode(), other.encode() + made.to_bytes(8, "little")))
    return out


def test_no_key_makes_forged_words_equal():
    for x, y in forged_words():
        data = np.frombuffer(x + y, np.uint8)
        for seed in (0, 1, 2**63 + 5):
            a, b = words.hash_spans(data, np.array([0, 16]), np.array([16, 32]), seed)
            assert a != b


def test_words_that_collide_for_known_seeds_are_kept_apart(spark):
    """Words of 16 letters that collided under the first seed of earlier versions, and the serial numbers that agreed in 32 bits."""
    pair = ("myrbzvkfyayjlwwr", "tkvgrlreey\\cw)da")
    texts = [" ".join([w] * 40 + [f"{w}{i}" for i in range(80)]) for w in pair]
    df = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    assert [r["component_id"] == r["doc_id"] for r in near_duplicates(df).collect()] == [True, True]
    assert without_near_duplicates(df).count() == 2
    left = suffix_dedup.without_repeats(df, suffix_dedup.repeated_passages(df)).collect()
    assert sorted(r["text"] for r in left) == sorted(texts)


def test_serial_numbers_before_one_passage_are_not_cut(spark):
    passage = " ".join(f"w{i}" for i in range(49))
    df = spark.range(300_000).select(F.col("id").alias("doc_id"), F.format_string("n%06d " + passage, "id").alias("text"))
    assert suffix_dedup.repeated_passages(df).where("not kept").count() == 0


def test_long_pretokens_are_encoded_in_windows(monkeypatch):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    path = public("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    rng = np.random.RandomState(2)
    long = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n)) for n in (90, 700, 5000)] + ["a" * 3000, "ab" * 900, "é" * 600]
    bpe = BacktrackingBpe(read_ranks(path))
    for window in (7, 64, 1 << 16):
        monkeypatch.setattr("codelattice.llm.bpe.WINDOW", window)
        assert [list(x) for x in bpe.encode_all([w.encode() for w in long])] == [library.encode_ordinary(w) for w in long]


def test_repeats_in_a_very_long_text(spark):
    n = 1_500_000
    text = F.array_join(F.concat(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), i.cast("string"))), F.array(*map(F.lit, ("w7", "w8", "w9")))), " ")
    df = spark.range(1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"))
    (r,) = quality.counts(df, []).select("n_words", "n_repeat_words").collect()
    assert (r["n_words"], r["n_repeat_words"]) == (n + 3, 6)


def test_fifty_languages_in_one_pass(spark):
    rng = np.random.RandomState(4)
    rows = []
    for k in range(50):
        own = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j)}" for j in range(25)]
        rows += [(100 * k + d, " ".join(rng.choice(own, 150)), f"l{k:02}") for d in range(4)]
    rows.append((9999, " ".join(f"zz{chr(97 + i % 26)}{chr(97 + i // 26)}q" for i in range(300)), None))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality.judge(df).collect()}
    assert len(got) == 201 and all(r["kept"] for i, r in got.items() if i != 9999) and not got[9999]["kept"]


def test_known_pretokens_do_not_rest_on_hashes(monkeypatch):
    monkeypatch.setattr(pretokens, "hash_spans", lambda data, starts, ends: words.hash_spans(data, starts, ends) & np.uint64(3))
    monkeypatch.setattr(pretokens.Known, "_other", lambda self, row, data, starts, ends: np.array([i for i, r in enumerate(row) if self._bytes[self._at[r] : self._at[r + 1]].tobytes() != data[starts[i] : ends[i]].tobytes()], np.int64))
    known = pretokens.Known(lambda ws: [list(w) for w in ws], 10_000, ([b"given"], [[7]]))
    rng = np.random.RandomState(4)
    for _ in range(20):
        ws = [bytes(rng.randint(97, 100, rng.randint(1, 12)).astype(np.uint8)) for _ in range(50)] + [b"given"]
        ends = np.cumsum([len(w) for w in ws])
        rows = known.rows(np.frombuffer(b"".join(ws), np.uint8), ends - [len(w) for w in ws], ends)
        values, places = known.expand(rows, np.arange(len(ws) + 1))
        assert [values[a:b].tolist() for a, b in itertools.pairwise(places.tolist())] == [[7] if w == b"given" else list(w) for w in ws]


def test_spans_are_compared_byte_by_byte():
    data = np.frombuffer(b"0123456789" * 30, np.uint8)
    n = np.array([0, 3, 8, 40, 64, 150])
    at = np.zeros(len(n), np.int64)
    assert words.same_bytes(data, at, data, at + 10, n).all()
    assert words.same_bytes(data, at, data, at + 1, n).tolist() == [True] + [False] * 5
    assert len(set(words.hash_spans(data, at, at + n).tolist())) == len(n)


def code_points():
    return [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]


def test_every_character_is_split_as_tiktoken_does():
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    path = public("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    _, known = encoder(path)
    table = pretokens.class_table("tiktoken", pretokens.class_runs("tiktoken"))
    every = code_points()
    texts = ["".join(f"a{c}a 1{c}1 {c}" for c in every[i : i + 512]) for i in range(0, len(every), 512)]
    for _, _, data, offsets in words.pieces(pa.array(texts)):
        starts, ends, firsts = pretokens.split(data, offsets, True, table)
        values, places = known.expand(known.rows(data, starts, ends), firsts)
        raw = data.tobytes()
        for (a, b), (x, y) in zip(itertools.pairwise(offsets.tolist()), itertools.pairwise(places.tolist())):
            assert values[x:y].tolist() == library.encode_ordinary(raw[a:b].decode())


def test_every_character_is_counted_and_encoded_as_tokenizers_does():
    tokenizers = pytest.importorskip("tokenizers")
    runs = pretokens.class_runs("tokenizers")
    table = pretokens.class_table("tokenizers", runs)
    path = public("word_bpe_49k.json")
    counter = token_counts.WordCounter(path, token_counts.prove(path), table)
    every = code_points()
    ours, odd = ([c for c in every if bool(counter.odd.search(c)) == x] for x in (False, True))
    texts = ["".join(f"a{c}a 1{c}1 É{c}̖ " for c in some[i : i + 128]) for some in (ours, odd) for i in range(0, len(some), 128)]
    assert len(ours) > 50_000
    library = tokenizers.Tokenizer.from_file(path)
    for i in range(0, len(texts), 5000):
        some = texts[i : i + 5000]
        want = np.array([len(e.ids) for e in library.encode_batch(some, add_special_tokens=False)])
        assert (counter.counts(some) == want).all()
    path = public("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    texts = ["".join(f"a{c}a 1{c}1 {c}" for c in every[i : i + 512]) for i in range(0, len(every), 512)]
    got = [x for _, _, data, offsets in words.pieces(pa.array(texts)) for x in token_files._ids(data, offsets, path, table)]
    for x, y in zip(got, texts, strict=True):
        assert x.tolist() == library.encode(y, add_special_tokens=False).ids


def test_other_patterns_are_refused(spark):
    with pytest.raises(ValueError):
        encode_decode(spark.createDataFrame([(1, "x")], "doc_id long, text string"), public("byte_bpe_multi_50k.tiktoken"), pattern=r"\S+")


def plain_fingerprint(text):
    """Order MinHash, step by step: (bin, hash of the pair) of each bin in use."""
    low = (1 << fp.PLACE_BITS) - 1

    def xx(*values):
        seed = 42
        for v in values:
            raw = v.encode() if isinstance(v, str) else int(v[1] if isinstance(v, tuple) else v).to_bytes(4 if isinstance(v, tuple) else 8, "little", signed=True)
            seed = xxhash.xxh64_intdigest(raw, seed)
        return seed - (1 << 64) if seed >> 63 else seed

    w = WORD.findall(text)
    hashes = [xx(*w[i : i + fp.K]) for i in range(len(w) - fp.K + 1)] if len(w) >= fp.K else [xx(" ".join(w), ("int", fp.K))] if w else []
    seen, values = collections.Counter(), []
    for place, h in enumerate(hashes):
        name = h & ~low
        values.append((xx(name, ("int", seen[name])) & ~low, place))
        seen[name] += 1
    values.sort()
    bin_ = lambda v: (v[0] % (1 << 64)) >> (64 - fp.BINS_LOG)
    bins = collections.defaultdict(list)
    for v in values:
        bins[bin_(v)].append(v)
    kept = [v for v in values if v in bins[bin_(v)][:2]]
    out = {}
    for i, v in enumerate(kept):
        if v == bins[bin_(v)][0]:
            other = kept[(i + 1) % len(kept)] if len(kept) > 1 else None
            a, b = sorted([v, other], key=lambda x: x[1]) if other else (v, None)
            out[bin_(v)] = (xx(a[0], b[0]) if b else xx(a[0])) & ((1 << fp.PAIR_BITS) - 1)
    return out


def plain_likeness(a, b):
    used = set(a) | set(b)
    return round(sum(a.get(x) == b.get(x) for x in used) / len(used), 6) if used else 1.0


def test_fingerprints_against_a_plain_version(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    rows += [(9000, None), (9001, "one"), (9002, "a b"), (9003, "a b c"), (9004, "a b a b a b a b c"), (9005, " ")]
    got = {r["doc_id"]: r for r in fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(((i, x or "") for i, x in rows), reverse=True)
    for (i, x), (_, y) in zip(order, order[1:] + order[:1]):
        h = len(x) // 2
        own, edited, after = plain_fingerprint(x), plain_fingerprint(x[: len(x) - h] + y[:h]), plain_fingerprint(y)
        entries = re.findall("." * 6, got[i]["fingerprint"])
        assert sorted(int(e, 16) for e in entries) == sorted((b << fp.PAIR_BITS) | v for b, v in own.items())
        assert got[i]["near_edited"] == plain_likeness(own, edited) and got[i]["near_next"] == plain_likeness(own, after)


@pytest.mark.parametrize("n", [20, 60, 130])
def test_fingerprints_of_short_texts_see_order(spark, n):
    """Blocks of four words that change places keep most k-mers; a one-k-mer MinHash would hardly fall."""
    rng = np.random.RandomState(n)
    near, far = [], []
    for _ in range(20):
        w = [f"w{x}" for x in rng.randint(0, 10**6, n)]
        half = n // 2
        near.append(plain_likeness(plain_fingerprint(" ".join(w)), plain_fingerprint(" ".join([*w[:-1], "new"]))))
        far.append(plain_likeness(plain_fingerprint(" ".join(w)), plain_fingerprint(" ".join(w[half:] + w[:half]))))
    assert np.mean(near) > np.mean(far) + 0.2 and np.mean(far) < 0.75


def test_one_document_and_rows_without_id(spark):
    schema = "doc_id long, text string, marks string, range string, next string"
    (one,) = fp.fingerprints(spark.createDataFrame([(1, "a b c d", "x", "y", "z")], schema)).collect()
    assert one["near_next"] == 1.0 and one["n_chars"] == 7
    assert fp.fingerprints(spark.createDataFrame([(None, "a"), (None, "a"), (None, None), (2, "b")], "doc_id long, text string")).count() == 4


def brute_passages(rows, tie_of):
    """Words of first places and words that are cut, by comparing all windows of all texts."""
    places = collections.defaultdict(list)
    for i, x in rows:
        w = WORD.findall(x or "")
        for at in range(len(w) - suffix_dedup.MIN_WORDS + 1):
            places[tuple(w[at : at + suffix_dedup.MIN_WORDS])].append((i, tie_of[i, x], x, at))
    holds, cut = set(), set()
    for found in places.values():
        if len(found) > 1:
            found.sort()
            for k, (i, _, x, at) in enumerate(found):
                (cut if k else holds).update((i, x, at + j) for j in range(suffix_dedup.MIN_WORDS))
    return holds, cut - holds


def passage_rows(seed):
    """Texts out of shared passages of 30 to 90 words between words of their own, near the least length and with shared neighbours."""
    rng = np.random.RandomState(seed)
    own = itertools.count()
    passages = [[f"p{k}x{j}" for j in range(rng.randint(30, 90))] for k in range(12)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = passages[rng.randint(12)]
            a = rng.randint(0, 12)
            parts += [f"o{next(own)}" for _ in range(rng.randint(0, 9))] + p[a : len(p) - rng.randint(0, 12)]
        rows.append((int(rng.randint(0, 40)), " ".join(parts)))
    return list(dict.fromkeys(rows))


@pytest.mark.parametrize("seed,all_open", [(1, False), (2, False), (3, True)])
def test_passages_against_brute_force(spark, monkeypatch, seed, all_open):
    """Several texts under one id; grams that are open are settled by windows."""
    rows = passage_rows(seed)
    df = spark.createDataFrame([*rows, *rows[:3]], "doc_id long, text string")
    text_of = {(r["doc_id"], r["tie"]): r["text"] for r in df.select("doc_id", "text", F.xxhash64("text").alias("tie")).collect()}
    holds, cut = brute_passages(rows, {(i, x): tie for (i, tie), x in text_of.items()})
    if all_open:
        judge = suffix_dedup._judge  # all grams as open ones, without Spark's workers
        monkeypatch.setattr(suffix_dedup, "_judge", lambda *a: judge(*a[:-1], set(np.ascontiguousarray(a[0][:, :8]).view(">u8").reshape(-1).tolist())))
        got = open_passages(df.select("doc_id", "text", F.xxhash64("text").alias("tie")).dropDuplicates().toArrow())
    else:
        got = [(r["doc_id"], r["tie"], r["start_word"], r["end_word"], r["kept"]) for r in suffix_dedup.repeated_passages(df).collect()]
    found = {kept: {(i, text_of[i, tie], at) for i, tie, a, b, k in got if k == kept for at in range(a, b)} for kept in (True, False)}
    assert found[False] == cut and found[True] == holds


def open_passages(table):
    """repeated_passages() in one process, every gram being open."""
    suffixes = pa.Table.from_batches(list(suffix_dedup._choose(table.select(["doc_id", "text", "tie"]).to_batches()))).to_pylist()
    twice = {g for g, n in collections.Counter(s["gram"] for s in suffixes).items() if n > 1}
    asked = collections.defaultdict(list)
    for s in suffixes:
        if s["gram"] in twice:
            asked[s["doc_id"], s["tie"]].append({k: s[k] for k in ("gram", "place", "least", "most")})
    kind = pa.list_(pa.struct([("gram", pa.int64()), ("place", pa.int32()), ("least", pa.int32()), ("most", pa.int32())]))
    rows = [r for r in table.to_pylist() if (r["doc_id"], r["tie"]) in asked]
    batch = pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in rows]), pa.array([r["text"] for r in rows]), pa.array([r["tie"] for r in rows]), pa.array([asked[r["doc_id"], r["tie"]] for r in rows], kind)], ["doc_id", "text", "tie", "places"])
    contexts = pa.Table.from_batches(list(suffix_dedup._contexts([batch]))).sort_by([(c, "ascending") for c in ("key", "left", "doc_id", "tie", "place")])
    key, left = (suffix_dedup._fixed(contexts[c].combine_chunks(), w) for c, w in (("key", 208), ("left", 200)))
    spans = list(zip(*(x.tolist() for x in suffix_dedup._judge(key, left, *(contexts[c].to_numpy() for c in ("doc_id", "tie", "place", "least", "most")), set()))))
    windows = collections.defaultdict(list)
    out = collections.defaultdict(list)
    for i, tie, at, to, stays, first, window, times in spans:
        if stays == 2:
            windows[window].append((i, tie, at, to, times))
        else:
            out[i, tie].append({"at": at, "to": to, "stays": bool(stays), "first_doc": first})
    for found in windows.values():
        found.sort()
        if sum(x[4] for x in found) > 1:
            for k, (i, tie, at, to, _) in enumerate(found):
                out[i, tie].append({"at": at, "to": to, "stays": not k, "first_doc": found[0][0]})
    merged = suffix_dedup._merge([pa.RecordBatch.from_arrays([pa.array([k[0] for k in out]), pa.array([k[1] for k in out]), pa.array(list(out.values()))], ["doc_id", "tie", "spans"])])
    return [tuple(r[c] for c in ("doc_id", "tie", "start_word", "end_word", "kept")) for b in merged for r in b.to_pylist()]


CLASH = "doc_id long, text string, row string, tie string, spans string, n_chars long"


def test_one_id_with_two_texts_keeps_what_is_unique(spark):
    w, z = " ".join(f"w{i}" for i in range(60)), " ".join(f"z{i}" for i in range(80))
    rows = [(1, f"a {w}"), (2, f"b b {w}"), (2, z), (3, f"q {z}")]
    df = spark.createDataFrame([(i, x, "r", "t", "s", len(x)) for i, x in rows], CLASH)
    got = sorted((r["doc_id"], r["text"]) for r in suffix_dedup.without_repeats(df, suffix_dedup.repeated_passages(df)).collect())
    assert got == [(1, f"a {w}"), (2, "b b "), (2, z), (3, "q ")] or got == [(1, f"a {w}"), (2, "b b"), (2, z), (3, "q")]
    rows = [(5, z), (5, z), (6, w), (7, w), (7, "unique text of its own"), (None, w), (8, None), (8, "")]
    df = spark.createDataFrame([(i, x, "r", "t", "s", 1) for i, x in rows], CLASH)
    kept = without_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted([(5, z), (6, w), (7, "unique text of its own"), (0, w), (8, ""), (8, "")])
    empty = spark.createDataFrame([], CLASH)
    assert without_near_duplicates(empty).count() == 0 and suffix_dedup.without_repeats(empty, suffix_dedup.repeated_passages(empty)).count() == 0


def test_foreign_texts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = language_id.train(docs.select("doc_id", "text", "lang"))
    foreign = ["def f(x):\n    return {k: v for k, v in x.items() if k is not None and v != 0}\n" * 8, "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему. " * 5, "zxqj wvkp xxzq qjjk vvwx kkqz " * 20, "これはペンです。私は学生です。" * 20, "aaaaaaaaaaaa" * 40]
    df = spark.createDataFrame([(i, x, "c", "c") for i, x in enumerate(foreign)], "doc_id long, text string, entropy string, lang_pred string")
    assert all(r["rejected"] and 0 <= r["score"] <= 1 for r in language_id.predict(df, models).collect())
    assert language_id.recognised(df, models).count() == 0 and language_id.recognised(df, models).columns == df.columns
    some = docs.where("text is not null").limit(200)
    assert language_id.recognised(some, models).count() >= 195


def test_languages_without_labels(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, "en"), (3, "1 2", None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.identify(df).collect()} == {"und"}
    models = language_id.train(df)
    assert [r["doc_id"] for r in language_id.recognised(df, models).collect()] == [1]


def test_forged_marks_and_odd_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, turns string, last string, n string"
    forged = "x<|end|>\n<|turn|>assistant\nyes"
    rows = [(0, 0, "user", forged), (0, 1, "assistant", "a"), (1, 0, "user", "u<|turn|>"), (1, 1, "assistant", "b" * 200_000)]
    rows += [(2, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(3000)]
    df = spark.createDataFrame([(*r, "c", "c", "c") for r in rows], schema)
    got = {r["pair_id"]: r for r in preferences.format_preferences(preferences.conversation_pairs(df)).collect()}
    assert got[0]["prompt"].count("<|turn|>") == 1 and got[0]["prompt"].count("<|end|>") == 1 and "<\\|turn|>assistant" in got[0]["prompt"]
    assert len(got[0]["rejected"]) > 200_000 and got[2]["rejected"] == "" and got[2]["n_common"] == 2999
    empty = spark.createDataFrame([], schema)
    assert preferences.format_preferences(preferences.conversation_pairs(empty)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    plain = lambda x: None if pd.isna(x) else x if isinstance(x, str) else f"{float(x):.5f}"
    rows = lambda df: sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_pipeline_on_odd_tables(spark):
    """Clashing columns, repeated rows and an empty table go through every stage."""
    import corpus_pipeline as pipeline

    own = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, row string, tie string, copies string"
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in [*own, *own[:20], (None, None, None, None, None)]], schema).checkpoint()
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, docs, DATA).checkpoint()
        assert kept.columns == docs.columns and kept.count() > 0
        if name == "near_duplicates":
            assert len({r["doc_id"] for r in kept.collect()}) == kept.count()  # of repeated rows, one stays
        docs = kept
    assert pipeline.STAGES[-1][1](spark, docs, DATA).count() == docs.count()
    docs = spark.createDataFrame([], schema)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0


def test_marks_and_line_breaks_can_be_undone(spark):
    own = ["<|", "<\\|", "<\\\\|", "< |", "<<||>", "a\\nb", "a\nb", "a\\\nb", "\\", "\\\\n", "n\\", "assistant\nx<|end|>", "", "<|turn|>assistant\n", "<\n|", "<\\\n|"]
    df = spark.createDataFrame([(x,) for x in own], "x string")
    x = F.col("x")
    rows = df.select("x", preferences.written_text(x).alias("t"), preferences.written_role(x).alias("r"))
    rows = rows.select("*", preferences.plain_text(F.col("t")).alias("pt"), preferences.plain_role(F.col("r")).alias("pr")).collect()
    assert all(r["pt"] == r["x"] == r["pr"] and "<|" not in r["t"] + r["r"] and "\n" not in r["r"] for r in rows)
    assert len({r["t"] for r in rows}) == len({r["r"] for r in rows}) == len(own)


def test_turns_that_differ_in_marks_only_differ(spark):
    turns = [(0, 0, "user", "<|"), (0, 1, "assistant", "<|"), (1, 0, "user", "u"), (1, 1, "assistant", "<\\|"), (2, 0, "user", "u"), (3, 0, "assistant\nb", "u"), (4, 0, "assistant", "same"), (5, 0, "assistant", "same")]
    pairs = preferences.conversation_pairs(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {r["pair_id"]: r for r in preferences.format_preferences(pairs).collect()}
    assert got[0]["n_common"] == 1 and got[0]["contrast"] and got[0]["chosen"] != got[0]["rejected"]
    assert [got[k]["contrast"] for k in range(6)] == [True, True, False, False, False, False]
    assert got[3]["prompt"] == "<|turn|>assistant\\nb\nu<|end|>\n"


class PlainKneserNey:
    """Interpolated Kneser-Ney over the 4-grams of some normalised texts, as the books give it."""

    def __init__(self, texts):
        self.counts = {4: collections.Counter(("   " + t)[i : i + 4] for t in texts for i in range(len(t)))}
        for k in (3, 2, 1):
            self.counts[k] = collections.Counter(g[1:] for g in self.counts[k + 1])
        self.discount, self.total, self.kinds = {}, {}, {}
        for k, c in self.counts.items():
            one, two = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
            self.discount[k] = one / (one + 2 * two) if one and two else 0.5
            self.total[k], self.kinds[k] = collections.Counter(), collections.Counter()
            for g, n in c.items():
                self.total[k][g[:-1]] += n
                self.kinds[k][g[:-1]] += 1

    def p(self, gram, letters):
        k = len(gram)
        if not k:
            return 1 / letters
        context = gram[:-1]
        below = self.p(gram[1:], letters)
        if not self.total[k][context]:
            return below
        d = self.discount[k]
        return (max(self.counts[k][gram] - d, 0) + d * self.kinds[k][context] * below) / self.total[k][context]


def test_language_models_equal_plain_kneser_ney(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    models = language_id.train(docs, 10**9)  # all documents are drawn
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("part")), F.lit(language_id.CALIBRATE))
    plain = lambda t: re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in t.lower())).lstrip()
    rows = docs.where("text is not null and lang is not null").withColumn("learns", part != 0).collect()
    books, letters = {}, {" "}
    for lang in models.languages:
        texts = [plain(r["text"]) for r in rows if r["learns"] and r["lang"] == lang]
        books[lang] = PlainKneserNey(texts)
        letters |= set("".join(texts))
    n = len(letters) + 1
    asked = [plain(r["text"])[:400] for r in rows if not r["learns"]][:25] + ["ζωή και qqq", "the the", "x"]
    got, sizes = models.cross_entropies(asked)
    for i, text in enumerate(asked):
        padded = "   " + text
        for j, lang in enumerate(models.languages):
            want = -sum(math.log(books[lang].p(padded[k : k + 4], n)) for k in range(len(text))) / len(text)
            assert sizes[i] == len(text) and abs(got[i, j] - want) < 1e-4, (text, lang)
