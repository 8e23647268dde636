"""Operators on small inline tables."""

import itertools
import random

from pyspark.sql import functions as F

from codelattice.functions import text as X
from codelattice.operators import graph, history, ranking, search, summaries, versions


def column(spark, expr, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", expr.alias("y")).orderBy("i").collect()]


def test_words_paths_and_cases(spark):
    x = F.col("x")
    assert column(spark, X.split_words(x), ["parseHTTPName2", "HTTPServer", "snake_case_9", "Éa", ""]) == ["parse http name 2", "http server", "snake case 9", "a", ""]
    assert column(spark, X.is_test_path(x), ["tests/a.py", "a/test_b.py", "a/b_test.py", "x/OrderTest.java", "it/x.py", "it.py", "contest.py"]) == [True, True, True, True, True, False, False]
    assert column(spark, X.dotted_suffix(x, "Order.add"), ["a.order.ADD", "Order.add", "xOrder.add", "É.order.add"]) == [True, True, False, True]
    assert column(spark, X.in_scope(x, F.lit(""), "src/Core/"), ["a/src/core/x.py", "src/core.py", "src/corex/y.py", "src/core/y.java"]) == [True, True, False, True]
    assert column(spark, X.external_type(x), ["Math", "java.util.List", "MAX", "list", "a.B.C"]) == [True, True, False, False, False]
    assert column(spark, X.clip(x, 5), ["a  b", "abcdefgh"]) == ["a b", "abcd…"]
    assert column(spark, X.line_count(x), ["", "a", "a\n", "a\nb"]) == [0, 1, 1, 2]
    assert column(spark, X.git_blob_id(F.encode(x, "utf-8")), ["hello\n"]) == ["ce013625030ba8dba906f756967f9e9ca394464a"]


def test_best_tier_keeps_ties_and_null_excludes(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, "b", 2), (1, "c", 1), (2, "d", None), (3, "e", 1)], "ref int, c string, tier int")
    assert sorted((r["ref"], r["c"]) for r in ranking.best_tier(df, ["ref"]).collect()) == [(1, "a"), (1, "b"), (3, "e")]


def test_budgeted_prefix_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([(1, "aaaa"), (2, "b" * 50), (3, "c")], "k int, text string")
    assert [r["k"] for r in ranking.prefix_within(df, "text", ["k"], 20).collect()] == [1]


def test_churn_follows_renames(spark):
    log = [  # newest first: d is born again, c was b and b was a
        (0, 50, "M", "c.py", None), (0, 50, "A", "d.py", None), (1, 40, "R", "c.py", "b.py"), (2, 30, "D", "d.py", None), (2, 30, "M", "b.py", None),
        (3, 20, "R", "b.py", "a.py"), (4, 10, "A", "a.py", None), (4, 10, "A", "d.py", None),
    ]
    df = spark.createDataFrame([("r", *x) for x in log], "repo string, pos int, time long, status string, path string, old_path string")
    got = {r["path"]: (r["churn"], r["last"]) for r in history.churn(df).collect()}
    assert got == {"c.py": (5, 50), "d.py": (1, 50)}


def naive_components(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            for n in nodes:
                if a in reach[n]:
                    reach[n].add(b)
    out = {frozenset(m for m in reach[n] if n in reach[m]) for n in nodes}
    return {c for c in out if len(c) > 1}


def test_components_and_loops_against_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    for n, m, few in ((6, 9, 100), (9, 12, 0)):  # labels are broadcast, and shuffled
        monkeypatch.setattr(graph, "BROADCAST_EDGES", few)
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        edges = {(a, b) for a, b in edges if a != b}
        df = spark.createDataFrame(sorted(edges), "src int, dst int")
        parts = graph.strong_components(df)
        got: dict[int, set] = {}
        for r in parts.collect():
            got.setdefault(r["component"], set()).add(r["node"])
        assert {frozenset(x) for x in got.values()} == naive_components(edges)
        for r in graph.shortest_loops(df, parts).collect():
            members = sorted(got[r["component"]])
            best = min(
                (p for k in range(1, len(members)) for p in itertools.permutations(members[1:], k) if all(e in edges for e in itertools.pairwise((members[0], *p, members[0])))),
                key=lambda p: (len(p), p),
            )
            assert r["loop"] == [members[0], *best, members[0]]


def test_pairing_matches_greedy_pairing(spark):
    rng = random.Random(3)
    side = lambda: [("f", rng.choice("abc"), rng.choice("xy"), i) for i in range(rng.randrange(1, 7))]
    for _ in range(3):
        old, new = side(), side()
        schema = "qn string, decl string, body string, ordinal int"
        pairs = versions.pair_versions(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), ["qn"], ["decl"], ["ordinal"])
        got = {(r["old"]["ordinal"] if r["old"] else None, r["new"]["ordinal"] if r["new"] else None) for r in pairs.collect()}
        left_old, left_new, want = list(old), list(new), set()
        for o in old:
            for w in left_new:
                if w[1] == o[1]:
                    want.add((o[3], w[3]))
                    left_old.remove(o)
                    left_new.remove(w)
                    break
        want |= {(o[3] if o else None, w[3] if w else None) for o, w in itertools.zip_longest(left_old, left_new)}
        assert got == want


def test_bm25_needs_every_prefix(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alphabet"), (3, "beta"), (4, "")], "id int, t string")
    sizes = docs.select("id", F.size(X.tokens(F.col("t"))).cast("bigint").alias("len"))
    got = search.bm25_prefix(search.postings(docs, ["id"], "t"), sizes, ["id"], ["alph", "bet"]).collect()
    assert [r["id"] for r in got] == [1]


def test_refresh_cascade(spark):
    schema = "path string, module string, hash string, size long, mtime_ns long"
    known = spark.createDataFrame([("a", "m", "1", 1, 10), ("b", "m", "1", 1, 10), ("c", "m", "1", 1, 10), ("d", "m", "1", 1, 10), ("e", "m", "1", 1, 9_000_000_000)], schema)
    found = spark.createDataFrame([("a", "m", "1", 1, 10), ("b", "m", "1", 1, 11), ("c", "n", "1", 1, 10), ("e", "m", "2", 1, 9_000_000_000), ("f", "m", "1", 1, 1)], schema)
    got = {r["path"]: r["action"] for r in history.refresh_cascade(known, found, last_run_ns=10_000_000_000).collect()}
    assert got == {"a": "unchanged", "b": "stat", "c": "parse", "d": "remove", "e": "parse", "f": "parse"}


def folded(log):
    """Churn of one repository by reading its log from the newest commit on."""
    called, count, last = {}, {}, {}
    for pos in sorted({r[0] for r in log}):
        commit = sorted((r for r in log if r[0] == pos), key=lambda r: r[1])
        for name in {called.get(r[4], r[4]) for r in commit} - {None}:
            count[name] = count.get(name, 0) + 1
            last.setdefault(name, commit[0][2])
        for _, _, _, status, path, old in commit:
            if status == "R":
                called[old] = called.get(path, path)
            if status in ("A", "R"):
                called[path] = None
    return {p: (count[p], last[p]) for p in count}


def test_churn_against_reading_the_log(spark):
    rng = random.Random(11)
    logs = {f"r{k}": [] for k in range(6)}
    for log in logs.values():
        names = [f"n{i}" for i in range(rng.randrange(3, 9))]
        for pos in range(rng.randrange(30, 80)):
            for k, path in enumerate(rng.sample(names, rng.randrange(1, 4))):
                status = rng.choice("MMMADRR")
                old = rng.choice([n for n in names if n != path]) if status == "R" else None
                log.append((pos, k, 10_000 - pos, status, path, old))
    logs["swap"] = [(0, 0, 9, "M", "a", None), (0, 1, 9, "M", "b", None), (1, 0, 8, "R", "b", "a"), (1, 1, 8, "R", "a", "b"), (2, 0, 7, "M", "a", None), (2, 1, 7, "M", "b", None)]
    df = spark.createDataFrame([(repo, *r) for repo, log in logs.items() for r in log], "repo string, pos int, k int, time long, status string, path string, old_path string").repartition(3)
    got: dict = {}
    for r in history.churn(df).collect():
        got.setdefault(r["repo"], {})[r["path"]] = (r["churn"], r["last"])
    assert got == {repo: folded(log) for repo, log in logs.items()}
    assert history.churn(df.limit(0)).count() == 0


def test_own_text_of_odd_nesting(spark):
    rng = random.Random(5)
    text = [f"line {i} # x" if i % 3 else f"// c {i}" for i in range(1, 401)]
    symbols = [(0, None, "class", 1, 400)]
    for _ in range(60):
        parent = rng.choice(symbols)
        a = rng.randint(parent[3], parent[4])
        symbols.append((len(symbols), parent[0], rng.choice(["method", "class"]), a, rng.randint(a, min(parent[4], a + 90))))
    schema = "path string, ordinal int, parent_ordinal int, kind string, start_line int, end_line int"
    df = spark.createDataFrame([("p", *s) for s in symbols] + [("q", 0, None, "method", 5, 4), ("q", 1, None, "method", 2, 2)], schema)
    lines = spark.createDataFrame([(p, i, t) for p in "pq" for i, t in enumerate(text, 1)], "path string, line int, text string")
    got = {(r["path"], r["ordinal"]): r["own"] for r in versions.own_texts(df, lines).collect()}
    want = {("q", 0): "", ("q", 1): "line2#x"}
    for o, _, kind, a, b in symbols:
        inner = {i for s in symbols if s[1] == o for i in range(s[3], s[4] + 1)}
        own = [text[i - 1].replace(" ", "") for i in range(a, b + 1) if i not in inner]
        want["p", o] = "".join(x for x in own if kind == "method" or not x.startswith(("//", "#")))
    assert got == want


def test_a_budget_without_groups_needs_no_single_task(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("k"), F.repeat(F.lit("x"), (F.col("id") % 9).cast("int")).alias("text")).repartition(7)
    got = ranking.prefix_within(df, "text", [F.desc("k")], 30_000)
    rows = sorted(((r["k"], len(r["text"])) for r in df.collect()), reverse=True)
    want, used = [], 0
    for k, n in rows:
        used += n + 1
        if used <= 30_000:
            want.append((k, used))
    assert sorted((r["k"], r["used"]) for r in got.collect()) == sorted(want)
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert ranking.prefix_within(df.limit(0), "text", ["k"], 10).count() == 0


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_close_names_against_brute_force(spark):
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(0, 7))) for _ in range(250)})
    words, known = names[::3], names[1::2]
    asked = spark.createDataFrame([(w,) for w in [*words, *words[:5], None]], "word string")
    held = spark.createDataFrame([(n, 1) for n in [*known, *known[:5], None]], "name string, word int")
    for most in (0, 1, 2):
        want = {(w, n, edits(w, n)) for w in words for n in known if edits(w, n) <= most}
        got = [tuple(r) for r in search.close_names(asked, held, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    first = {}
    for r in search.closest(asked, held, 2).collect():
        first.setdefault(r["word"], []).append((r["place"], r["distance"], r["name"]))
    for w in words:
        best = sorted((edits(w, n), n) for n in known if edits(w, n) <= 2)[:2]
        assert [x[1:] for x in sorted(first.get(w, []))] == best
    assert search.close_names(asked.limit(0), held).count() == 0


def test_lookups_go_by_kind_of_change(spark):
    rows = [("body", "method", 1), ("removed", "class", 9), ("signature", "method", 5), ("added", "method", 0), ("removed", "field", 2), ("body", "function", 0), ("removed", "method", 9)]
    df = spark.createDataFrame(rows, "change string, kind string, line int")
    first, beyond = summaries.within_lookups(df, ["line", "kind", "change"], 3)
    assert {tuple(r) for r in first.collect()} == {("removed", "class", 9), ("removed", "method", 9), ("signature", "method", 5)}
    assert {tuple(r) for r in beyond.collect()} == {("body", "function", 0), ("body", "method", 1)}


def test_naming_imports_count_once(spark):
    gone = spark.createDataFrame([("java", "a.B.c", "a/B.java"), ("python", "a.B.c", "x.py")], "language string, qualified_name string, path string")
    imports = spark.createDataFrame(
        [("p.java", "java", 0, 1, "a.B", "c", True), ("p.java", "java", 1, 2, "a.B.c", "d", True), ("p.java", "java", 2, 3, "a.B.c", None, False), ("q.py", "python", 0, 1, "a.B", "c", False), ("q.py", "python", 1, 1, "a.B", None, False)],
        "path string, language string, ordinal int, line int, module string, name string, is_static boolean",
    )
    got = summaries.naming_imports(gone, imports).collect()
    assert sorted((r["path"], r["i_path"], r["i_ordinal"]) for r in got) == [("a/B.java", "p.java", 0), ("a/B.java", "p.java", 1), ("x.py", "q.py", 0)]
