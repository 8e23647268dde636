"""Refreshes and waits; folders and clips of answers; the streamed refresh; the server."""

import io
import json
import threading
import time

from pyspark.sql import functions as F

from codelattice.api import CodeIndex, left_out, side_by_side, whole_lines
from codelattice.functions.text import source_root
from codelattice.serve import Server
from codelattice.sources.files import Index
from codelattice.streaming.freshness import Freshness, Published
from codelattice.streaming.refresh import watch


def test_one_refresh_at_a_time_and_bounded_waits():
    go, calls, current = threading.Event(), [], []

    def refresh():
        calls.append(1)
        go.wait(5)
        current.append(Published("v1", time.time()))

    f = Freshness(refresh, lambda: current[-1] if current else None, patience=0.05, first_patience=0.05)
    a, b = f.asked(), f.asked()
    assert a is b and f.look() == (None, "the first version of the index is not complete yet")
    go.set()
    a.result(5)
    seen = f.look()
    assert seen.index.version == "v1" and seen.remark == "" and len(calls) == 2


def test_failed_refresh_answers_from_the_old_index():
    def fail():
        raise OSError("disk full")

    seen = Freshness(fail, lambda: Published("v0", time.time() - 60)).look()
    assert seen.index.version == "v0" and "OSError: disk full" in seen.remark and "60 s ago" in seen.remark
    assert Freshness(fail, lambda: None).look().index is None


def test_layout(spark, tmp_path):
    page = CodeIndex(spark, str(tmp_path)).page
    assert page(["h"], [("a/b/x.py", "1"), ("a/b/y.py", "2"), ("a/b/x.py", "3")], 600, 3, 10) == "h\nall paths below a/b/\nx.py\n  1\n  3\ny.py\n  2"
    assert page(["h"], [("a/x.py", "1"), ("a/y.py", "2")], 600, 2, 10) == "h\na/x.py\n  1\na/y.py\n  2"
    cut = page(["h"], [(None, "x" * 100) for _ in range(50)], 600, 50, 50)
    assert len(cut) <= 1800 and cut.endswith("no room for more; ask for less at a time)")
    kinds = page(["h"], [(None, "f")], 600, 3, 1, kinds=["class"], of_kind={"class": 1, "method": 2})
    assert kinds.endswith("limit=3 lists them all) 2 method")
    assert left_out(3, 3, 10) == "" and "limit=200 is the most" in left_out(500, 200, 200)
    assert whole_lines(["h" * 100] * 50, 600).endswith("lines left out)") and len(whole_lines(["h" * 100] * 50, 600)) <= 1800
    new, old = side_by_side("f(" + "a, " * 60 + "b)", "f(" + "a, " * 60 + "c)", 60)
    assert max(len(new), len(old)) <= 60 and new != old and new.startswith("…")


def test_source_root(spark):
    rows = [("java/src/com/x/", "com.x"), ("com/x/", "com.x"), ("xcom/x/", "com.x"), ("a/", "")]
    got = spark.createDataFrame(rows, "d string, p string").select(source_root(F.col("d"), F.col("p"))).collect()
    assert [r[0] for r in got] == ["java/src/", "./", None, None]


def test_streamed_refresh(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("def f():\n    pass\n")
    query = watch(spark, str(tmp_path / "src"), str(tmp_path / "index"))
    query.awaitTermination(60)
    assert [r["name"] for r in Index(spark, str(tmp_path / "index")).tables()["symbols"].collect()] == ["f"]


def test_server(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("def norm_it():\n    pass\n")
    code = CodeIndex(spark, str(tmp_path / "index"), str(tmp_path / "src"))
    server = Server(code)
    server.freshness.first_patience = server.freshness.patience = 60
    asks = [
        {"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"},
        {"id": 3, "method": "tools/call", "params": {"name": "search_symbols", "arguments": {"query": "norm"}}},
        {"id": 4, "method": "tools/call", "params": {"name": "get_symbol"}}, {"id": 5, "method": "nothing"},
    ]
    out = io.StringIO()
    server.serve(io.StringIO("".join(json.dumps(a) + "\n" for a in asks) + "not json\n"), out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r["id"] for r in got] == [1, 2, 3, 4, 5, 0]
    assert len(got[1]["result"]["tools"]) == 8 and all(t["description"] for t in got[1]["result"]["tools"])
    assert got[2]["result"]["content"][0]["text"].startswith("1 symbols match norm") and not got[2]["result"]["isError"]
    assert [r["error"]["code"] for r in got[3:]] == [-32602, -32601, -32600]
    assert code.symbol_or_words("norm").startswith("1 symbols match norm") and "function a.norm_it" in code.symbol_or_words("norm_it")
