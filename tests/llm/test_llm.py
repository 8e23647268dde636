"""The ten first operators and the pipeline on small tables, against brute force and the libraries."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelattice.llm import fingerprints as fp
from codelattice.llm import language_id, mixing, preferences, quality, suffix_dedup, token_counts, token_files
from codelattice.llm.bpe import BacktrackingBpe, encode_decode, merged_by_rank, read_ranks
from codelattice.llm.minhash import near_duplicates, without_near_duplicates

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, row string, label string"


def public(name):
    return pytest.importorskip("public_tokenizers").path(name)


@pytest.fixture(scope="module")
def raw(spark):
    """Documents with every odd case: nulls, blanks, copies, repeated rows, a very long text, clashing columns."""
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()]
    passage = " ".join(f"w{i}" for i in range(60))
    rows += [(9001, None, "en", "src1"), (9002, "", None, None), (9003, " \n\t", "fr", None), (9004, "one", "en", "src1"), (9005, "Ab ab", "de", "src2")]
    rows += [(9010, "x " + passage + " y z", "en", "src3"), (9011, "a b c " + passage + " d", "en", "src3"), (9012, "x x " * 30_000, "en", "src4"), (9013, "é" * 5000, "fr", "src5")]
    rows += [(9020, rows[0][1], "en", "src1"), (9020, rows[0][1], "en", "src1"), (9021, rows[0][1] + " tail", "en", "src6"), (9030, "<|endoftext|> it's 12  \n ok<|endoftext|>", "en", "src6"), (9031, "ΑΣ İ é \U0001f600　!", None, "￿")]
    return [(*r, len(r[1]) if r[1] is not None else None, "clash", "k", "r", "l") for r in rows]


@pytest.fixture(scope="module")
def docs(spark, raw):
    return spark.createDataFrame(raw, SCHEMA).repartition(5).checkpoint()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_fingerprints(docs, raw, empty):
    got = collections.defaultdict(list)
    for r in fp.fingerprints(docs).collect():
        got[r["doc_id"]].append(r)
    assert sum(map(len, got.values())) == len(raw)
    order = sorted(((r[0], r[1] or "") for r in raw), key=lambda r: -r[0])
    for (i, x), (_, y) in zip(order, order[1:] + order[:1]):
        h = len(x) // 2
        assert hashlib.sha256((x[: len(x) - h] + y[:h]).encode()).hexdigest() in {r["edited_sha256"] for r in got[i]}
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and r["n_chars"] == len(x) for r in got[i])
    assert got[0][0]["fingerprint"] == got[9020][0]["fingerprint"] != got[9021][0]["fingerprint"]
    assert got[9001][0]["fingerprint"] == got[9002][0]["fingerprint"] == ""
    assert fp.fingerprints(empty).count() == 0


def test_fingerprints_follow_order_and_repeats(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [words, words[200:] + words[:200], words[:390] + ["new"] * 10, words + words]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").select("doc_id", fp.order_minhash(F.col("text")).alias("m"))
    m = {r["doc_id"]: r["m"] for r in df.collect()}
    like = lambda a, b: len(set(m[a]) & set(m[b])) / len({x >> fp.PAIR_BITS for x in (*m[a], *m[b])})
    assert like(0, 2) > 0.8 > like(0, 1) > 0.2  # the same words, half of all pairs in another order
    assert like(0, 3) < 0.5  # every k-mer once more


def test_language_models(docs, raw, empty):
    rows = {r["doc_id"]: r for r in language_id.identify(docs.select("doc_id", "text", "lang")).collect()}
    known = {r[0]: r[2] for r in raw if r[0] < 9000}
    right = [rows[i]["lang_pred"] == lang for i, lang in known.items() if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(right) >= 0.95 * len(right)
    for i in (9001, 9002, 9003):
        assert (rows[i]["lang_pred"], rows[i]["score"], rows[i]["rejected"]) == ("und", 0.0, True)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in rows.items())
    assert language_id.identify(empty.select("doc_id", "text", "lang")).count() == 0


def test_kneser_ney_sums_to_one():
    text = "abracadabra banana band"
    points, _ = language_id.normalised([text])
    real = np.flatnonzero(points != 1)
    flat = np.where(points == 1, 32, points)
    grams, n = np.unique(np.stack([flat[real - j] for j in range(3, -1, -1)], axis=1), axis=0, return_counts=True)
    m = language_id.fit(["x"], np.zeros(len(n), int), grams, n)
    letters = sorted(set(text))
    for context in ("abr", "zzz", "ana"):
        total = 0
        for c in letters:
            a = m.cross_entropies([context + c])[0][0, 0] * 4 - m.cross_entropies([context])[0][0, 0] * 3
            total += np.exp(-a)
        assert 0.9 < total < 1.0001


def test_bpe_is_exact(docs, raw, empty):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    path = public("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    want = {(r[0], r[1]): hashlib.sha256(np.array(library.encode_ordinary(r[1] or ""), "<u4").tobytes()).hexdigest() for r in raw}
    got = encode_decode(docs, path).collect()
    assert sorted((r["doc_id"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted((r[0], want[r[0], r[1]], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in raw)
    assert encode_decode(empty, path).count() == 0


def test_bpe_backtracks():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259, b"aa": 260, b"aaaa": 261, b"bcd": 262}
    bpe = BacktrackingBpe(ranks)
    for n in range(1, 7):
        for w in itertools.product(b"abcd", repeat=n):
            assert bpe.encode_all([bytes(w)]) == [merged_by_rank(ranks, bytes(w))], bytes(w)


def test_mixing(docs, raw, empty):
    rows = mixing.mix(docs.drop("key")).collect()
    assert len(rows) == len(raw)
    sizes = collections.Counter()
    for r in raw:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = dict(zip(order, itertools.cycle((5.0, 2.0, 1.0))))
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] < level * weights[s]}
        target |= {s: 2.0 * sizes[s] for s in full} if full else {s: level * weights[s] for s in open_}
        left -= sum(2 * sizes[s] for s in full)
        open_ = open_ - full if full else set()
    taken, most = collections.Counter(), collections.Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * (1 + target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) <= most[s] for s in order)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    assert mixing.mix(empty).count() == 0


def test_repeated_passages(docs, raw, empty):
    got = suffix_dedup.repeated_passages(docs).collect()
    words = {r[0]: WORD.findall(r[1] or "") for r in raw}
    spans = {(r["doc_id"], r["kept"]): r for r in got if r["doc_id"] in (9010, 9011)}
    assert (spans[9010, True]["start_word"], spans[9010, True]["end_word"]) == (1, 61)
    assert (spans[9011, False]["start_word"], spans[9011, False]["end_word"], spans[9011, False]["first_doc_id"]) == (3, 63, 9010)
    count = collections.Counter(tuple(w[i : i + 50]) for d, w in words.items() for i in range(len(w) - 49))
    for r in got:
        w = words[r["doc_id"]][r["start_word"] : r["end_word"]]
        assert r["kept"] or any(count[tuple(w[i : i + 50])] > 1 for i in range(max(1, len(w) - 49))) or len(w) < 50
    covered = collections.defaultdict(set)
    for r in got:
        covered[r["doc_id"]] |= set(range(r["start_word"], r["end_word"]))
    repeated = {(d, i) for d, w in words.items() if d != 9012 for i in range(len(w) - 49) if count[tuple(w[i : i + 50])] > 1}
    caught = sum(set(range(i, i + 50)) <= covered[d] for d, i in repeated)
    assert caught >= 0.95 * len(repeated)
    assert suffix_dedup.repeated_passages(empty).count() == 0


def test_cutting_passages(spark, docs):
    got = {r["doc_id"]: r for r in suffix_dedup.without_repeats(docs, suffix_dedup.repeated_passages(docs)).collect()}
    assert got[9011]["text"] == "a b c d" and got[9011]["n_chars"] == 7 and got[9011]["size"] == "clash"
    assert got[9010]["text"].startswith("x w0 ") and 9002 not in got


def test_preferences(spark):
    turns = [(0, 0, "system", "s"), (0, 1, "user", "u"), (0, 2, "assistant", "a"), (1, 0, "user", "v"), (1, 1, "assistant", "é"), (1, 2, "user", None), (2, 0, None, "q"), (4, 0, "assistant", "x"), (4, 0, "assistant", "x"), (None, 0, "user", "u"), (5, None, "user", "u")]
    pairs = preferences.conversation_pairs(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {r["pair_id"]: r for r in preferences.format_preferences(pairs).collect()}
    assert sorted(got) == [0, 1, 2, 4]
    assert got[0]["prompt"] == "<|turn|>system\ns<|end|>\n<|turn|>user\nu<|end|>\n" and got[0]["n_common"] == 2
    assert (got[0]["chosen"], got[0]["rejected"]) == ("<|turn|>assistant\na<|end|>\n", "<|turn|>assistant\né<|end|>\n")
    for r in got.values():
        for text, mask in ((r["chosen"], r["chosen_mask"]), (r["rejected"], r["rejected_mask"])):
            assert [text[m["start"] : m["end"]] for m in mask] == re.findall(r"(?<=<\|turn\|>assistant\n).*?<\|end\|>\n", text)
    assert got[1]["chosen"].endswith("<|turn|>user\n<|end|>\n") and got[2]["prompt"] == "<|turn|>unknown\nq<|end|>\n" and got[2]["rejected"] == ""


def test_token_counts(docs, raw, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = public("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    want = sorted((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in raw)
    got = token_counts.token_counts(docs, path).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want and all(r["over_limit"] == (r["n_tokens"] > 2048) for r in got)
    assert token_counts.token_counts(empty, path).count() == 0


def test_token_files(docs, raw, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = public("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    want, at = [], 0
    for r in sorted(raw, key=lambda r: r[0]):
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = token_files.write_and_read(docs, path).collect()
    assert sorted(map(tuple, got)) == want
    assert token_files.write_and_read(empty, path).count() == 0


def test_blocks_decode_from_checkpoints_and_notice_damage():
    rng = np.random.RandomState(1)
    ids = np.minimum(rng.zipf(1.3, 300_000), 999).astype(np.uint32)
    coder = token_files.Coder(token_files.shared_table(np.bincount(ids, minlength=1000)))
    block = coder.encode(ids)
    assert (coder.decode(block) == ids).all() and len(block) < 2 * len(ids)
    step = token_files.CHECKPOINT * token_files.LANES
    for k in range(-(-len(ids) // step)):
        assert (coder.decode(block, k) == ids[k * step : (k + 1) * step]).all()
    for n in (0, 1, 511, 512, 513):
        assert (coder.decode(coder.encode(ids[:n])) == ids[:n]).all()
    with pytest.raises(ValueError):
        coder.decode(b"\0" * len(block))


def shingle_sets(raw, k):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for r in raw:
        w = WORD.findall((r[1] or "").translate(low))
        out[r[0]] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def test_near_duplicates(docs, raw, empty):
    sets = shingle_sets(raw, 3)
    label = {i: i for i in sets}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    got = near_duplicates(docs).collect()
    assert len(got) == len(raw)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {(i, len(s), label[i], label[i] == i) for i, s in sets.items()}
    assert near_duplicates(empty).count() == 0


def test_near_duplicate_groups_without_a_common_neighbour(spark):
    """A chain: each text is like the next one only, so no text is like all others."""
    words = [f"w{i}" for i in range(400)]
    rows = [(100 + i, " ".join([*words[20 * i :], *(f"x{j}" for j in range(20 * i))])) for i in range(8)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {100}
    assert without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).count() == 1


def spread_copies(n, edits, seed):
    """n copies of one text under random ids, each with up to so many words of its own, spread out."""
    rng = np.random.RandomState(seed)
    rows = []
    for i in rng.permutation(10 * n)[:n].tolist():
        words = [f"w{j}" for j in range(402)]
        for j in rng.permutation(np.arange(5, 395, 6))[: rng.randint(1, edits + 1)]:
            words[j] = f"own{i}x{j}"
        rows.append((i, " ".join(words)))
    return rows


def least_of_components(rows, k, percent):
    sets = shingle_sets(rows, k)
    order = sorted(sets)
    columns = {w: c for c, w in enumerate(sorted(set().union(*sets.values())))}
    has = np.zeros((len(order), len(columns)), np.float32)
    for r, i in enumerate(order):
        has[r, [columns[w] for w in sets[i]]] = 1
    both = has @ has.T
    alike = 100 * both >= percent * (has.sum(1)[:, None] + has.sum(1)[None, :] - both)
    label = np.arange(len(order))
    while True:
        new = np.where(alike, label[None, :], len(order)).min(1)
        if (new == label).all():
            return {i: order[x] for i, x in zip(order, label)}
        label = new


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_in_a_large_group_of_spread_copies(spark, monkeypatch, seed):
    """Many members are linked with few others, and hardly ever with a bucket's least one."""
    from codelattice.llm import minhash

    rows = spread_copies(600, 10, seed)
    want = least_of_components(rows, 3, 85)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(df).collect()} == want
    if seed == 1:
        monkeypatch.setattr(minhash, "PART_SHINGLES", 20_000)
        assert {r["doc_id"]: r["component_id"] for r in near_duplicates(df).collect()} == want


def test_near_duplicate_pages_of_one_template(spark, monkeypatch):
    """Pages that share most words but no link meet in many tables; beyond one part, only those that can have a link are copied."""
    from codelattice.llm import minhash

    common, rows = [f"w{j}" for j in range(240)], []
    for i in range(300):
        own = [f"own{i}x{j}" for j in range(90)]
        rows.append((2 * i, " ".join([*common, *own])))
        if i % 30 == 0:
            rows.append((2 * i + 1, " ".join([*common, *own[:-4], "a", "b", "c", "d"])))
    want = least_of_components(rows, 3, 85)
    assert sum(i != x for i, x in want.items()) == 10
    parts, may_link = [], minhash._may_link
    monkeypatch.setattr(minhash, "PART_SHINGLES", 5_000)
    monkeypatch.setattr(minhash, "_may_link", lambda *x: parts.append(may_link(*x)) or parts[-1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(df).collect()} == want
    assert parts and parts[0].count() <= 20


def test_near_duplicate_stage_against_brute_force(spark):
    """The pipeline's stage keeps the least of each component at 0.8, and few pairs at 0.8 meet in no table."""
    import corpus_pipeline as pipeline
    from codelattice.llm import minhash

    rows = spread_copies(500, 8, 3)
    want = least_of_components(rows, 5, 80)
    df = spark.createDataFrame([(i, x, "en", "src1", len(x)) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in pipeline.drop_near_duplicates(spark, df, DATA).collect()} == set(want.values())
    assert {p: minhash.groups_for(p) for p in (80, 85, 100)} == {80: 10, 85: 8, 100: 1}


def test_quality(docs, raw, empty):
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for i, x, *_ in raw:
        w = WORD.findall(x or "")
        lines = [line for line in (x or "").split("\n") if WORD.search(line)]
        seen = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        repeat = {k for j in range(len(w) - 2) if seen[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in "".join(w)), len(lines) - len(set(lines)), len(repeat))
        assert tuple(got[i])[1:6] == want
        assert got[i]["base_failed"] == (len(w) < 50 or 100 * len(repeat) > 50 * len(w)) and not (got[i]["base_failed"] and got[i]["kept"])
    assert sum(r["kept"] for r in got.values()) > 0.5 * len(got)
    assert quality.judge(empty).count() == 0


def test_divergence_by_hand(spark):
    df = spark.createDataFrame([([1, 1], 2), ([2, 0], 2)], "h array<bigint>, n bigint")
    got = [r[0] for r in df.select(quality.js_distance(F.col("h"), F.col("n"), [0.5, 0.5])).collect()]
    assert got[0] == 0 and abs(got[1] - 0.5579230452841438) < 1e-9


def test_pipeline(spark, raw):
    import corpus_pipeline as pipeline

    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "mixing", "tokens"]
    docs = spark.createDataFrame([r[:5] for r in raw], "doc_id long, text string, lang string, source string, n_chars long").dropDuplicates().checkpoint()
    columns, given = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, docs, DATA).checkpoint()
        assert kept.columns == columns
        if name != "mixing":
            assert 0.8 * given <= kept.count() <= docs.count()
        docs = kept
    left = {r["doc_id"] for r in docs.collect()}
    assert not left & {9001, 9002, 9003} and 9020 not in left  # no letter; a copy of document 0
    assert pipeline.STAGES[-1][1](spark, docs, DATA).count() == docs.count()
    assert pipeline.run(spark, DATA).count() > 0
