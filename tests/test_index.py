"""The bucketed index: what a refresh writes and reads, postings, micro-batches, and modules of Python paths."""

import json
import os

import pytest
from pyspark.sql import functions as F

from codelattice.functions.text import tokens
from codelattice.operators import search
from codelattice.sources import files
from codelattice.sources.files import Index, indexed_words
from codelattice.sources.python_code import module_of, package_dirs
from codelattice.streaming.refresh import upsert


def write(root, name, text):
    os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
    with open(f"{root}/{name}", "w") as f:
        f.write(text)
    os.utime(f"{root}/{name}", (1_000_000_000, 1_000_000_000))


def changed(root, name, text):
    write(root, name, text)
    os.utime(f"{root}/{name}", (1_000_000_100, 1_000_000_100))


@pytest.fixture
def many(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "BUCKET_FILES", 4)
    root = str(tmp_path / "src")
    for k in range(40):
        write(root, f"p{k % 4}/m{k}.py", f"def run_job{k}(a):\n    return parseHTTP{k}(a)\nclass Shop{k}:\n    def sell(self): pass\n")
    index = Index(spark, str(tmp_path / "index"))
    assert index.refresh(root) == {"parse": 40}
    return index, root


def data_files(index):
    return {os.path.join(d, n) for d, _, names in os.walk(index.folder) for n in names if n.endswith(".parquet")}


def rows(df):
    return sorted(map(str, df.collect()))


def test_one_changed_file_rewrites_one_bucket(spark, many):
    index, root = many
    assert index.manifest()["buckets"] == 16
    assert index.refresh(root) == {"unchanged": 40}
    before, tables = data_files(index), {n: rows(t.where("path <> 'p1/m5.py'")) for n, t in index.tables().items()}
    changed(root, "p1/m5.py", "def other_name(x, y):\n    return run_job1(x)\n")
    assert index.refresh(root) == {"unchanged": 39, "parse": 1}
    made = data_files(index) - before
    assert before <= data_files(index)
    assert len({f.split("bucket=")[1].split("/")[0] for f in made if "bucket=" in f}) == 1
    assert sum("bucket=" in f for f in made) <= 4 and sum("/postings/" in f for f in made) <= 4
    now = index.tables()
    assert {n: rows(t.where("path <> 'p1/m5.py'")) for n, t in now.items()} == tables
    assert [r["name"] for r in now["symbols"].where("path = 'p1/m5.py'").collect()] == ["other_name"]


def test_removed_added_and_touched_files(spark, many):
    index, root = many
    os.remove(f"{root}/p2/m6.py")
    write(root, "p2/new.py", "def fresh(): pass\n")
    os.utime(f"{root}/p3/m7.py", (1_000_000_050, 1_000_000_050))
    assert index.refresh(root) == {"unchanged": 38, "remove": 1, "parse": 1, "stat": 1}
    t = index.tables()
    assert {r["path"] for r in t["files"].collect()} == {f"p{k % 4}/m{k}.py" for k in range(40) if k != 6} | {"p2/new.py"}
    assert t["files"].where("path = 'p3/m7.py'").first()["mtime_ns"] == 1_000_000_050 * 10**9
    assert t["postings"].where("path = 'p2/m6.py'").count() == 0 and t["postings"].where("term = 'fresh'").count() == 1
    assert index.refresh(root) == {"unchanged": 40}


def check_search(index):
    t = index.tables()
    docs = indexed_words(t["symbols"])
    sizes = docs.select("path", "ordinal", F.size(tokens(F.col("text"))).cast("bigint").alias("len"))
    whole = search.postings(docs, ["path", "ordinal"], "text")
    assert rows(t["postings"].select(*whole.columns)) == rows(whole)
    total = sizes.agg(F.count("*"), F.sum("len")).first()
    assert t.statistics == tuple(total)
    for words in (["run"], ["s", "shop1"], ["parse", "http"], ["other"]):
        got, want = (search.bm25_prefix(p, s, ["path", "ordinal"], words).withColumn("score", F.round("score", 9)) for p, s in ((t["postings"], t.statistics), (whole, sizes)))
        assert rows(got) == rows(want)


def test_postings_follow_the_symbols(spark, many, monkeypatch):
    index, root = many
    check_search(index)
    monkeypatch.setattr(files, "MOST_DELTAS", 3)
    for k in range(5):  # deltas, a merge, and deltas again; one file changes twice
        changed(root, "p0/m0.py", f"def other{k}(x): pass\n" * (k + 1))
        os.utime(f"{root}/p0/m0.py", (1_000_000_200 + k, 1_000_000_200 + k))
        changed(root, f"p1/m{4 * k + 1}.py", "def run_other(): pass\n")
        index.refresh(root)
        check_search(index)
    assert len(index.manifest()["segments"]) < 5


def test_search_reads_the_row_groups_of_its_prefixes(spark, many):
    index, _ = many
    plan = search.bm25_prefix(index.tables()["postings"], (1, 1), ["path", "ordinal"], ["shop1"])._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,shop1)" in plan
    import pyarrow.parquet as pq

    for f in data_files(index):
        if "/postings/" in f:
            terms = pq.read_table(f)["term"].to_pylist()
            assert terms == sorted(terms)


def test_a_replayed_batch_changes_nothing(spark, many, monkeypatch):
    index, root = many
    changed(root, "p1/m1.py", "def batched(): pass\n")
    changed(root, "p1/m5.py", "def not_in_the_batch(): pass\n")
    seen = []
    read = files.read_files
    monkeypatch.setattr(files, "read_files", lambda paths, *a, **k: (seen.append({r["path"] for r in paths.collect()}), read(paths, *a, **k))[1])
    batch = spark.createDataFrame([(f"file:{root}/p1/m1.py",), (f"file:{root}/p1/m1.py",), (f"file:{root}/p9/none.py",)], "path string")
    assert upsert(batch, 0, root, index.folder) == {"parse": 1}
    assert seen[0] == {"p1/m1.py"} and set().union(*seen) == {"p1/m1.py"}
    state, data = json.dumps(index.manifest()), data_files(index)
    assert upsert(batch, 0, root, index.folder) == {}
    assert json.dumps(index.manifest()) == state and data_files(index) == data
    names = {r["name"] for r in index.tables()["symbols"].collect()}
    assert "batched" in names and "not_in_the_batch" not in names
    monkeypatch.undo()
    assert index.refresh(root)["parse"] == 1


def test_a_new_package_moves_the_modules_around_it(spark, many):
    index, root = many
    write(root, "p1/__init__.py", "")
    batch = spark.createDataFrame([(f"file:{root}/p1/__init__.py",)], "path string")
    assert upsert(batch, 7, root, index.folder) == {"parse": 11}
    assert {r["module"] for r in index.tables()["files"].where("path in ('p1/m1.py', 'p2/m2.py')").collect()} == {"p1.m1", "m2"}
    check_search(index)


TREES = [
    ["a/__init__.py", "a/x.py", "a/b/c/__init__.py", "a/b/c/y.py"],
    ["a/__init__.py", "a/b/z.py", "a/b/c/__init__.py", "a/b/c/y.py", "a/b/c/d/e/f.py"],
    ["__init__.py", "x.py", "src/pkg/__init__.py", "src/pkg/m.py", "src/tool.py", "src/pkg/sub/n.py", "other/deep/er/o.py"],
    ["p/q/__init__.py", "p/m.py", "p/q/r/s.py", "p/q/r/t/__init__.py", "p/q/r/t/u.py", "A.java"],
]


@pytest.mark.parametrize("paths", TREES)
def test_modules_of_python_paths(spark, paths):
    df = spark.createDataFrame([(v, p, "java" if p.endswith(".java") else "python") for v in ("one", "two") for p in paths if v == "one" or "c/__init__" not in p], "version string, path string, language string")
    got = {(r["version"], r["path"]): (r["module"], r["is_package"]) for r in files.with_modules(df).collect()}
    for v in ("one", "two"):
        own = [p for w, p in got if w == v and p.endswith(".py")]
        for p in own:
            assert got[v, p] == module_of(p, package_dirs(own)), (v, p)
    assert all(got[k] == (None, None) for k in got if k[1].endswith(".java")) and len(got) == df.count()


def test_labels_give_the_ancestors_that_parents_give(spark, tmp_path):
    from codelattice.operators import hierarchy

    root = str(tmp_path / "src")
    write(root, "a.py", "class A:\n  class B:\n    def f(self):\n      def g():\n        class C: pass\n      return g\n    def h(self): pass\n  x = 1\ndef top(): pass\n")
    write(root, "b.java", "class P { enum E { X { int x() { return 1; } } } static class Q { void m() { Runnable r = new Runnable() { public void run() {} }; } } void n() {} }")
    index = Index(spark, str(tmp_path / "index"))
    index.refresh(root)
    s = index.tables()["symbols"]
    closure = hierarchy.ancestors(s, ["path"], "parent_ordinal", "ordinal")
    assert rows(hierarchy.around(s).where("depth > 0").select("path", "node", "ancestor", "depth")) == rows(closure.select("path", "node", "ancestor", "depth"))
    assert rows(hierarchy.outermost_callables(s).select("path", "ordinal")) == rows(hierarchy.outermost_callables(s, closure).select("path", "ordinal"))
    assert s.where("depth >= 2").count() > 2
