"""The resolver on many call sites and candidates in few files or of one name: what it shuffles grows no faster than they do."""

import pytest

from codelattice.functions import lineage
from codelattice.operators.resolve import Resolver
from codelattice.plans import code_relations
from codelattice.sources.model import LABELS, TABLES


def relation(spark, name, rows):
    parts = [p.split(" ", 1) for p in TABLES[name].split(", ")]
    empty = {"boolean": False, "array<string>": []}
    made = [tuple(r.get(c, empty.get(kind)) for c, kind in parts) for r in rows]
    return spark.createDataFrame(made, TABLES[name]).drop(*LABELS)


def shuffled(spark, run):
    """(rows of run(), records and bytes that its stages wrote for shuffles)."""
    sc = spark.sparkContext
    store = sc._jsc.sc().statusStore()

    def total():
        stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        each = {stages.apply(i).stageId(): (stages.apply(i).shuffleWriteRecords(), stages.apply(i).shuffleWriteBytes()) for i in range(stages.size())}
        return each

    before = set(total())
    rows = run()
    new = [v for k, v in total().items() if k not in before]
    return rows, sum(v[0] for v in new), sum(v[1] for v in new)


def records(n):
    """n files with a call of `x.size()`, n records with that accessor; each file imports one record."""
    use = [f"use/C{i}.java" for i in range(n)]
    own = [f"rec/R{i}.java" for i in range(n)]
    files = [{"path": p, "language": "java", "module": "use"} for p in use] + [{"path": p, "language": "java", "module": "rec"} for p in own]
    symbols = [{"path": p, "ordinal": 0, "kind": "record", "name": f"R{i}", "qualified_name": f"rec.R{i}"} for i, p in enumerate(own)]
    symbols += [{"path": p, "ordinal": 1, "parent_ordinal": 0, "kind": "field", "name": "size", "qualified_name": f"rec.R{i}.size", "signature": "int size"} for i, p in enumerate(own)]
    symbols += [{"path": p, "ordinal": 0, "kind": "class", "name": f"C{i}", "qualified_name": f"use.C{i}"} for i, p in enumerate(use)]
    imports = [{"path": p, "ordinal": 0, "module": "rec", "name": f"R{i}"} for i, p in enumerate(use)]
    refs = [{"path": p, "ordinal": 0, "enclosing_ordinal": 0, "kind": "call", "name": "size", "receiver": "x", "arg_count": 0, "line": 1, "col": 1} for p in use]
    return {"files": files, "symbols": symbols, "imports": imports, "refs": refs}


def bindings(n):
    """One file with n functions of its own, and n calls of names that it doesn't bind."""
    files = [{"path": "a.py", "language": "python", "module": "a"}, {"path": "b.py", "language": "python", "module": "b"}]
    symbols = [{"path": p, "ordinal": i, "kind": "function", "name": f"{p[0]}{i}", "qualified_name": f"{p[0]}.{p[0]}{i}"} for p in ("a.py", "b.py") for i in range(n)]
    refs = [{"path": "a.py", "ordinal": i, "kind": "call", "name": f"b{i}", "arg_count": 0, "line": i, "col": 1} for i in range(n)]
    return {"files": files, "symbols": symbols, "imports": [], "refs": refs}


@pytest.mark.parametrize(("make", "n", "measure"), [(records, 150, 1), (bindings, 400, 2)])
def test_shuffles_grow_no_faster_than_the_input(spark, make, n, measure):
    def run(size):
        tables = {k: relation(spark, k, v) for k, v in make(size).items()}
        return shuffled(spark, lambda: {(r["path"], r["ref"], r["qualified_name"], r["tier"]) for r in Resolver(tables).resolve().collect()})

    small, large = run(n), run(4 * n)
    want = {(f"use/C{i}.java", 0, f"rec.R{i}.size", 2) for i in range(4 * n)} if make is records else {("a.py", i, f"b.b{i}", 1) for i in range(4 * n)}
    assert large[0] == want
    assert large[measure] < 6 * small[measure]  # as the input does: four times, and some


def test_each_way_of_a_tier(spark):
    """Methods that a file can name by a package that it imports, by all names of a module, and by neither; a base's method; the innermost function."""
    sym = lambda path, ordinal, kind, qn, **more: {"path": path, "ordinal": ordinal, "kind": kind, "name": qn.rsplit(".", 1)[-1], "qualified_name": qn, **more}
    symbols = [sym("p/m.py", 0, "class", "p.m.A"), sym("p/m.py", 1, "method", "p.m.A.go", parent_ordinal=0), sym("q.py", 0, "class", "q.B", bases=["A"]), sym("q.py", 1, "method", "q.B.go", parent_ordinal=0)]
    symbols += [sym("u.py", 0, "function", "u.f"), sym("u.py", 1, "function", "u.f.go", parent_ordinal=0), sym("u.py", 2, "function", "u.f.go.g", parent_ordinal=1)]
    files = [{"path": p, "language": "python", "module": m} for p, m in (("p/m.py", "p.m"), ("q.py", "q"), ("u.py", "u"), ("v.py", "v"), ("w.py", "w"))]
    imports = [{"path": "u.py", "ordinal": 0, "module": "p"}, {"path": "v.py", "ordinal": 0, "module": "q", "name": "*"}]
    call = lambda path, ref, receiver, inside=None, name="go": {"path": path, "ordinal": ref, "kind": "call", "name": name, "receiver": receiver, "enclosing_ordinal": inside, "arg_count": 0, "line": ref, "col": 1}
    refs = [call("u.py", 0, "x"), call("v.py", 0, "x"), call("w.py", 0, "x"), call("q.py", 0, "self", 1), call("q.py", 1, "super()", 1), call("u.py", 1, None, 2), call("w.py", 1, None, None, "g"), call("q.py", 2, "self", None)]
    tables = {k: relation(spark, k, v) for k, v in {"files": files, "symbols": symbols, "imports": imports, "refs": refs}.items()}
    found = Resolver(tables).resolve().select("path", "ref", "qualified_name", "tier")
    assert {tuple(r) for r in found.collect()} == {
        ("u.py", 0, "p.m.A.go", 2), ("v.py", 0, "q.B.go", 2), ("w.py", 0, "p.m.A.go", 1), ("w.py", 0, "q.B.go", 1), ("q.py", 0, "q.B.go", 3), ("q.py", 1, "p.m.A.go", 2),
        ("u.py", 1, "u.f.go", 3), ("q.py", 2, "p.m.A.go", 1), ("q.py", 2, "q.B.go", 1),
    }


def broadcast_rows(spark, run):
    """Rows of each broadcast that run() makes."""
    store = spark._jsparkSession.sharedState().statusStore()

    def each():
        return [store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())]

    before = set(each())
    run()
    rows = []
    for i in set(each()) - before:
        nodes, told = store.planGraph(i).allNodes(), store.executionMetrics(i)
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if node.name().startswith("BroadcastExchange"):
                metrics = [node.metrics().apply(k) for k in range(node.metrics().size())]
                counts = [told.get(m.accumulatorId()) for m in metrics if m.name() == "number of output rows"]
                rows += [int(c.get().replace(",", "")) for c in counts if c.isDefined()]
    return rows


@pytest.mark.parametrize("name", ["resolve_python_functions", "resolve_python_methods", "resolve_java"])
def test_what_is_broadcast_is_counted(spark, monkeypatch, name):
    """Symbols, imports, bindings, parts and call sites are beyond the bound, and small as files; the run's own sizes of shuffles stay out of it."""
    monkeypatch.setattr(lineage, "BROADCAST_ROWS", 50, raising=False)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "16k", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = broadcast_rows(spark, lambda: code_relations.QUERIES[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save())
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert all(n <= 50 for n in rows), rows
