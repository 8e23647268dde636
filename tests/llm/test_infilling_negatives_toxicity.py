"""Fill-in-the-middle, hard negatives and toxicity: brute force, round trips and odd rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelattice.llm import hard_negatives, infilling, toxicity
from codelattice.llm.language_id import held_out

DATA = "/root/testdata/sf0.001"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


# --- fill-in-the-middle ----------------------------------------------------------------------------------


def plain_infill(i, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return n, "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


ODD = [None, "", " ", " \n\t ", "one", "a  b ", "<P>", "x <S> y", "<<M", "< P > <", "\U0001f600 é ü z", "a\x0bb\x0cc\x1cd", "x " * 40_000, "y" * 200_000, "\\$1 \\E (x)", "tail   "]


def test_infilling_against_a_plain_version(spark):
    rows = [(i, t, "clash") for i, t in enumerate(ODD * 12)] + [(None, "no id at all", "c"), (3, "same row", "c"), (3, "same row", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string").repartition(3)
    got = infilling.infill_digests(docs).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, n, form, a, b, sha(out), sha(t or "")) for i, t, _ in rows for n, form, a, b, out in [plain_infill(i, t)]]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_infilling_is_one_narrow_native_pass(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plan = infilling.infill_digests(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert infilling.infill_digests(docs.limit(0)).count() == 0


def test_every_piece_is_found_again(spark):
    docs = spark.createDataFrame([(i, "<" * (i % 3) + f" a{i}> b<P c S> M>" + ">" * (i % 4)) for i in range(200)], "doc_id long, text string")
    rows = infilling.infilled(docs, percent=100)
    assert rows.where(infilling.restored(F.col("output"), F.col("form")) != F.col("text")).count() == 0
    assert rows.where("form = 'plain'").count() == 0 and rows.where("concat(prefix, middle, suffix) <> text").count() == 0


# --- hard negatives ---------------------------------------------------------------------------------------


def plain_negatives(rows, positives=5, negatives=3):
    kept = []
    for i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        y = (y + 1) % 10 if i % 7 == 0 else y
        kept.append((i, [int(np.floor(256 * float(x))) for x in v], y))
    out = []
    for k, (i, q, y) in enumerate(kept):
        if i % 50:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, v)), j, z) for m, (j, v, z) in enumerate(kept) if m != k), key=lambda s: s[:2])
        for s, j, _ in [s for s in scored if s[2] == y][:positives]:
            own = [t for t in scored if t[2] != y and 50 * -s <= 100 * -t[0] <= 95 * -s][:negatives]
            out += [(i, j, r, t[1], -s, -t[0]) for r, t in enumerate(own, 1)]
    return sorted(out)


def mined(df):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hard_negatives.mine(df, label=label)
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got.collect())


@pytest.fixture
def vectors():
    rng = np.random.RandomState(5)
    v = np.clip(rng.normal(size=(700, 8)), -2, 2).astype(np.float32)
    rows = [(i, v[i].tolist(), int(i % 3)) for i in range(700)]
    rows += [(1000 + i, v[3].tolist(), 1) for i in range(40)]  # one common vector: ties
    rows += [(50, v[50].tolist(), 2), (50, v[50].tolist(), 2), (7, v[7].tolist(), 1)]  # repeated rows, an anchor among them
    rows += [(2000, None, 1), (2050, v[0].tolist(), None), (None, v[0].tolist(), 1), (2100, [float("nan")] * 8, 1), (2150, [None] + v[0].tolist()[1:], 1), (2200, [float("inf")] + v[0].tolist()[1:], 1), (2250, v[0].tolist()[:5], 1)]
    return rows


@pytest.mark.parametrize("chunk, leaf", [(16_384, 64), (64, 4)])
def test_hard_negatives_against_brute_force(spark, vectors, monkeypatch, chunk, leaf):
    monkeypatch.setattr(hard_negatives, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(hard_negatives, "LEAF_ROWS", leaf)
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").withColumn("chunk", F.lit("clash")).withColumn("query", F.lit(1))
    want = plain_negatives(vectors)
    assert len(want) > 100 and mined(df.repartition(5)) == want
    assert mined(df.limit(0)) == []


def test_hard_negatives_of_large_components(spark):
    rows = [(i, [float((i % 5 + 1) * 2**16), float(i % 7)], i % 2) for i in range(0, 300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert mined(df) == plain_negatives(rows)


def test_bounds_prune_nodes():
    rng = np.random.RandomState(1)
    centres = rng.normal(size=(20, 8)) * 400
    x = np.floor(np.concatenate([c + rng.normal(size=(200, 8)) for c in centres])).astype(np.int64)
    tree, ids = hard_negatives.BallTree(x, 16), np.arange(len(x))
    q = hard_negatives.Queries(x[:5], np.full(5, -(2**62)), np.full(5, 2**62), 3)
    looked = []
    look = q._look
    q._look = lambda t, i, rows, who: (looked.append(len(rows) * len(who)), look(t, i, rows, who))
    q.search(tree, ids, np.arange(5))
    every = x[:5] @ x.T
    assert [sorted(a) for a in q.score.tolist()] == [sorted(np.sort(a)[-3:].tolist()) for a in every]
    assert sum(looked) < every.size / 4


# --- toxicity ---------------------------------------------------------------------------------------------


def test_block_max_index_against_all_cosines(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    rng = np.random.RandomState(3)
    dense = np.where(rng.rand(300, 40) < 0.1, rng.randint(1, 4, (300, 40)), 0).astype(float)
    dense[100:140] = dense[100]  # ties
    norm = np.sqrt((dense**2).sum(axis=1))
    dense = dense / np.where(norm > 0, norm, 1)[:, None]
    doc, term = np.nonzero(dense)
    ids = rng.permutation(300)
    index = toxicity.BlockMaxIndex(doc, term, dense[doc, term], rng.randint(0, 2, 300), ids, 40)
    asked = np.concatenate([dense[::7], np.zeros((2, 40))])
    a, b = np.nonzero(asked)
    like, who = index.nearest(a, b, asked[a, b], len(asked), 6)
    number = np.append(index.ids, -1)[who]
    for i, q in enumerate(asked):
        cos = (dense @ q).round(9)
        best = sorted((-s, k) for s, k in zip(cos, ids) if s > 0)[:6]
        assert [(-s, n) for s, n in zip(like[i], number[i]) if s > 0] == [(s, k) for s, k in best]


def test_toxicity_of_held_out_rows(spark):
    rng = np.random.RandomState(9)
    words = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        text = rng.choice(words, 40).tolist()
        bad = i % 6 == 0
        if bad:
            for w in rng.choice(["vilename", "dreadful", "loathing"], 3):
                text[rng.randint(40)] = w
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    rows += [(5000, None), (5001, ""), (5002, "\n \t"), (5003, rows[0][1]), (5003, rows[0][1]), (None, rows[1][1]), (5004, "Vilename! " * 50_000), (5005, "word1 word2")]
    labels += [(None, 1), (5001, None), (77, 0)]
    docs = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in rows], "doc_id long, text string, label string, score double").repartition(3)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.toxicity(docs, table, held_out).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(900))
    assert all(by[i]["predicted"] == int(i % 6 == 0) == int(by[i]["score"] >= 0.5) for i in range(900))
    assert all(0 <= r["score"] <= 1 for r in got) and by[5004]["predicted"] == 1
    assert by[5000]["score"] == by[5001]["score"] == by[5002]["score"] < 0.1
    near = by[0]["evidence"]
    assert near and near[0]["label"] == 1 and near[0]["similarity"] == max(e["similarity"] for e in near)
    assert toxicity.toxicity(docs.limit(0), table, held_out).count() == 0
    assert {r["score"] for r in toxicity.toxicity(docs, table.limit(0), held_out).collect()} == {0.0}


def test_scores_do_not_rest_on_labels_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r["doc_id"], r["score"]) for r in toxicity.toxicity(docs, x, held_out).collect()) for x in (labels, flipped))
    assert a == b
