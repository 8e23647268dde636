"""Extraction, resolution, refresh and answers on a small repository of our own."""

import subprocess

import pytest

from codelattice.api import CodeIndex
from codelattice.operators.resolve import Resolver
from codelattice.sources.java_code import extract_java
from codelattice.sources.python_code import extract_python, module_of, package_dirs, resolve_relative

FILES = {
    "inv/__init__.py": "from .models import Item as PublicItem, make\n",
    "inv/models.py": '''"""Items."""
from typing import TYPE_CHECKING
import inv.util as u
if TYPE_CHECKING:
    from inv.store import Store
class Base:
    def save(self, x=1, *rest): return u.norm(x)
class Item(Base):
    @staticmethod
    def parse(text: str) -> "Item":
        return Item()
    def touch(self):
        self.save(1)
        other.save(3)
        def inner():
            return make()
        return inner()
def make(n=None):
    return Item.parse("a")
''',
    "inv/util.py": "def norm(v):\n    from inv.store import Store\n    return Store(v)\n",
    "inv/store.py": "from inv import PublicItem\nfrom inv.models import *\nclass Store:\n    def __init__(self, v): self.v = v\n    def load(self):\n        it = PublicItem.parse('x')\n        it.touch()\n        return make(*[1])\n",
    "inv/bad.py": "def broken(:\n  x = foo(1)\n",
    "tests/test_inv.py": "from inv.util import norm\ndef test_norm():\n    norm(1)\n",
    "core/Order.java": """package core;
import static core.Money.round;
/** An order. */
public class Order extends Base<Item> {
    enum Kind { SMALL(1), BIG(2) { int x() { return helper(); } }; Kind(int n) {} int helper() { return 1; } }
    record Line(String name, int count) { Line { check(name); } static void check(String s) {} }
    Order() { this(1); }
    Order(int n) { super(n); }
    void add(Item item, int... more) { items.add(item); round(1.0); this.total(); }
    double total() { return Money.round(items.stream().map(Item::price).count()); }
    static Order of(String s) { Runnable r = new Runnable() { public void run() { of("x"); } }; return new Order(1).copy(); }
    Order copy() { Line l = new Line("a", 1); l.count(); return super.me(); }
}
""",
    "core/Base.java": "package core;\nabstract class Base<T> { protected Base(int n) {} Order me() { return null; } }\nclass Item { int price() { return 1; } }\ninterface Money { static double round(double d) { return Math.round(d); } }\n",
}


def git(root, *args, when="2026-10-01T00:00:00Z"):
    env = {"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when, "PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": str(root)}
    subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True, env=env)


@pytest.fixture(scope="module")
def code(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for name, text in FILES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    git(root, "init", "-q")
    git(root, "add", "-A")
    git(root, "commit", "-qm", "one")
    index = CodeIndex(spark, str(tmp_path_factory.mktemp("index")), str(root))
    assert index.refresh() == {"parse": len(FILES)}
    return index


def test_python_extract():
    got = extract_python(FILES["inv/models.py"].encode(), "inv.models", False)
    kinds = {s["qualified_name"]: (s["kind"], s["param_count"], s["is_varargs"]) for s in got["symbols"]}
    assert kinds["inv.models.Base.save"] == ("method", 3, True)
    assert kinds["inv.models.Item.touch.inner"] == ("function", 0, False)
    parse = next(s for s in got["symbols"] if s["name"] == "parse")
    assert (parse["start_line"], parse["decorators"], parse["signature"]) == (9, ["staticmethod"], 'def parse(text: str) -> "Item"')
    assert [i["is_type_only"] for i in got["imports"]] == [False, False, True]
    assert {(r["name"], r["receiver"], r["arg_count"]) for r in got["refs"]} >= {("norm", "u", 1), ("save", "self", 1), ("make", None, 0), ("parse", "Item", 1)}


def test_broken_python_is_flagged_and_scanned():
    got = extract_python(FILES["inv/bad.py"].encode(), "inv.bad", False)
    assert got["has_errors"] and [s["name"] for s in got["symbols"]] == ["broken"] and [r["name"] for r in got["refs"]] == ["foo"]


def test_one_syntax_error_leaves_the_rest_whole():
    source = '''import os
class A(Base):
    """Doc."""
    @deco
    def f(self, a,
          b=1):
        """Of f."""
        return g(a, b)
    def bad(self, x:
        return h(x)
    def after(self):
        x = = broken(1)
        return k(1, 2)
'''
    got = extract_python(source.encode(), "m", False)
    by = {s["qualified_name"]: s for s in got["symbols"]}
    assert got["has_errors"] and set(by) == {"m.A", "m.A.f", "m.A.bad", "m.A.after"}
    assert by["m.A"]["doc"] == "Doc." and by["m.A.f"]["decorators"] == ["deco"] and (by["m.A.f"]["param_count"], by["m.A.f"]["signature"]) == (3, "def f(self, a, b=1)")
    assert {(r["name"], r["arg_count"]) for r in got["refs"]} >= {("g", 2), ("h", 1), ("k", 2), ("broken", None)}


def test_many_syntax_errors_leave_the_rest_whole():
    source = "class A:\n" + "".join(f"    def f{i}(self, x):\n        print 'x', g{i}(x)\n        return h{i}(x)\n" for i in range(60))
    source += "".join(f"def top{i}(a):\n    print a\n    k{i}()\n\n" for i in range(60)) + '"""\ntext\ndef no(\n"""\ndef last(a, *b):\n    z(\n        1)\n'
    got = extract_python(source.encode(), "m", False)
    by = {s["qualified_name"]: s for s in got["symbols"]}
    assert got["has_errors"] and set(by) == {"m.A", "m.last"} | {f"m.A.f{i}" for i in range(60)} | {f"m.top{i}" for i in range(60)}
    assert all((by[f"m.A.f{i}"]["kind"], by[f"m.A.f{i}"]["start_line"], by[f"m.A.f{i}"]["end_line"]) == ("method", 3 * i + 2, 3 * i + 4) for i in range(60))
    assert (by["m.last"]["param_count"], by["m.last"]["is_varargs"]) == (2, True)
    assert sorted((r["name"], r["arg_count"] is None) for r in got["refs"]) == sorted([(f"{x}{i}", x == "g") for x in "ghk" for i in range(60)] + [("z", False)])


def test_long_headers_are_kept():
    source = "def f(" + ",\n".join(f"a{i}" for i in range(100)) + "):\n    return 1\n"
    assert extract_python(source.encode(), "m", False)["symbols"][0]["signature"].startswith("def f(a0, a1, a2")


def test_arguments_that_compare():
    counts = {r["name"]: r["arg_count"] for r in extract_java(b"class A { void f() { g(a < b, c > d); h(new HashMap<A, B>(), x); k(Map<A, B>::new, 1); l(x.<A, B>of(), 2); m(a < b, c > (d)); } }")["refs"] if r["kind"] == "call"}
    assert (counts["g"], counts["h"], counts["k"], counts["l"], counts["m"]) == (2, 2, 2, 2, 2)


def test_deep_expression():
    assert len(extract_python(("x = " + " + ".join(["f(1)"] * 300)).encode(), "m", False)["refs"]) == 300


def test_modules():
    packages = package_dirs(["a/__init__.py", "a/b/c.py", "x/y.py"])
    assert [module_of(p, packages)[0] for p in ("a/__init__.py", "a/b/c.py", "x/y.py", "z.py", "__init__.py")] == ["a", "a.b.c", "y", "z", "__init__"]
    assert resolve_relative("..m", "a.b.c", False) == "a.m"
    assert resolve_relative(".", "a", True) == "a"
    assert resolve_relative("....m", "a.b", False) == "....m"


def test_java_extract():
    got = extract_java(FILES["core/Order.java"].encode())
    by = {(s["qualified_name"], s["kind"]): s for s in got["symbols"]}
    assert by["core.Order", "class"]["bases"] == ["Base"] and by["core.Order", "class"]["doc"] == "An order."
    assert by["core.Order.Line.Line", "constructor"]["param_count"] == 2
    assert (by["core.Order.add", "method"]["param_count"], by["core.Order.add", "method"]["is_varargs"]) == (2, True)
    assert ("core.Order.Kind.BIG", "field") in by and not any(s["name"] == "run" for s in got["symbols"])
    refs = {(r["kind"], r["name"], r["receiver"], r["arg_count"]) for r in got["refs"]}
    assert {("constructor_call", "this", None, 1), ("method_ref", "price", "Item", None), ("new", "Kind", None, 1), ("call", "copy", "new Order(1)", 0), ("call", "of", None, 1)} <= refs
    assert not got["has_errors"] and extract_java(b"class A { void f( { }")["has_errors"]


def test_resolution(code):
    got = {}
    for r in Resolver(code.tables).resolve().collect():
        got.setdefault((r["path"], r["name"], r["receiver"]), set()).add((r["qualified_name"], r["tier"]))
    want = {
        ("inv/models.py", "norm", "u"): {("inv.util.norm", 3)},
        ("inv/models.py", "save", "self"): {("inv.models.Base.save", 2)},
        ("inv/models.py", "save", "other"): {("inv.models.Base.save", 2)},
        ("inv/models.py", "inner", None): {("inv.models.Item.touch.inner", 3)},
        ("inv/store.py", "parse", "PublicItem"): {("inv.models.Item.parse", 3)},
        ("inv/store.py", "make", None): {("inv.models.make", 2)},
        ("core/Order.java", "this", None): {("core.Order.Order", 3)},
        ("core/Order.java", "super", None): {("core.Base.Base", 3)},
        ("core/Order.java", "round", None): {("core.Money.round", 3)},
        ("core/Order.java", "round", "Money"): {("core.Money.round", 3)},
        ("core/Order.java", "price", "Item"): {("core.Item.price", 3)},
        ("core/Order.java", "count", "l"): {("core.Order.Line.count", 2)},
        ("core/Order.java", "me", "super"): {("core.Base.me", 2)},
        ("core/Order.java", "Line", None): {("core.Order.Line", 3), ("core.Order.Line.Line", 3)},
    }
    assert {k: got.get(k) for k in want} == want
    assert ("core/Base.java", "round", "Math") not in got  # a type that isn't indexed


def test_answers(code):
    assert "inv.models.Item.parse" in code.get_symbol("Item.parse")
    assert "2 call sites in 2 files: 1 exact, 1 likely" in code.find_references("inv.models.make")
    assert code.search_symbols("norm").startswith("2 symbols match norm")
    assert "test_norm" not in code.search_symbols("norm", path="inv.*")
    assert "inv -> inv.models" in code.module_dependencies()
    assert code.module_dependencies("nothing").startswith("no module")
    assert "1 with parse errors" in code.repo_summary()
    assert "Order.java: " in code.file_outline("core/Order.java")
    assert code.file_outline(f"{code.root}/core/Order.java").startswith("core/Order.java: ")
    assert "left out" not in code.file_outline("core/Order.java", 500) and "500 is not within 1 to 200" in code.file_outline("core/Order.java", 500)
    assert " field" in code.file_outline("core/Order.java", 3).splitlines()[-1]
    assert "0 in tests" in code.find_references("inv.models.make") and "1 in tests" in code.find_references("inv.util.norm")
    assert "did you mean" in code.get_symbol("inv.Itm.pars") or "no symbol" in code.get_symbol("inv.Itm.pars")


def test_history_impact_and_refresh(code):
    from pathlib import Path

    root = Path(code.root)
    before = {r["path"]: r["hash"] for r in code.tables["files"].collect()}
    (root / "inv/util.py").write_text(FILES["inv/util.py"].replace("norm(v)", "norm(v, w=1)"))
    (root / "inv/store.py").rename(root / "inv/shop.py")
    git(root, "add", "-A")
    git(root, "commit", "-qm", "two", when="2026-11-01T00:00:00Z")
    counts = code.refresh()
    assert counts["parse"] >= 2 and counts["remove"] == 1
    after = {r["path"]: r["hash"] for r in code.tables["files"].collect()}
    assert set(after) == set(before) - {"inv/store.py"} | {"inv/shop.py"} and after["core/Order.java"] == before["core/Order.java"]
    assert set(code.refresh()) <= {"unchanged", "stat"}
    hot = code.hotspots()
    assert "inv/shop.py: 8" in hot or "inv/shop.py: 10" in hot
    from codelattice.sources import datasource, git as vcs

    datasource.register(code.spark)
    log = code.spark.read.format("git_log").option("root", str(root)).option("since", "2026-01-01").load()
    assert {(r["status"], r["path"], r["old_path"]) for r in log.where("pos = 0").collect()} == {("M", "inv/util.py", None), ("R", "inv/shop.py", "inv/store.py")}
    tree = code.spark.read.format("git_tree").option("root", str(root)).option("commit", "HEAD~1").load()
    assert {r["path"] for r in tree.collect()} == set(FILES)
    assert {bytes(r["content"]).decode() for r in vcs.blobs(tree, str(root)).collect()} == set(FILES.values())
    with pytest.raises(ValueError):
        vcs.commit_of(str(root), "--output=x")
    assert {r[6] for r in vcs.log_rows(str(root / "inv"), "2026-01-01")} == {"__init__.py", "models.py", "util.py", "store.py", "shop.py", "bad.py"}  # below the root only
    impact = code.diff_impact("HEAD~1", "HEAD")
    assert "[removed] inv.store.Store: " in impact and "[signature] inv.util.norm: " in impact
    (root / "core/Base.java").write_bytes(FILES["core/Base.java"].replace("\n", "\r\n").encode())  # other line ends only
    (root / "inv/util.py").write_text("def norm(v, w=2):\n    return v\n")
    assert "1 files, 1 symbols changed: 1 signature" in code.diff_impact("HEAD")


@pytest.fixture
def small(spark, tmp_path):
    """A repository in which p.a only imports from p.b, and p.b and p.c import each other."""
    root = tmp_path / "repo"
    (root / "p").mkdir(parents=True)
    (root / "p/__init__.py").write_text("")
    (root / "p/a.py").write_text("from p.b import Kept\nfrom p.b import Gone\n")
    (root / "p/b.py").write_text("import p.c\nclass Gone:\n    pass\nclass Kept:\n    pass\nclass Alone:\n    pass\n")
    (root / "p/c.py").write_text("import p.b\n" + "".join(f"def thing_{i}(): pass\n" for i in range(205)))
    git(root, "init", "-q")
    git(root, "add", "-A")
    git(root, "commit", "-qm", "one")
    index = CodeIndex(spark, str(tmp_path / "index"), str(root))
    index.refresh()
    return index


def test_impact_counts_imports_of_removed_symbols(small):
    with open(f"{small.root}/p/b.py", "w") as f:
        f.write("import p.c\nclass Kept:\n    pass\n")
    git(small.root, "commit", "-qam", "two")
    small.refresh()
    impact = small.diff_impact("HEAD~1", "HEAD")
    assert "[removed] p.b.Gone: 0 strong, 0 weak; still imported 1 times (p/a.py:2)" in impact
    assert "files outside the diff that import a touched module: 2 (0 tests): p/a.py, p/c.py" in impact
    assert "[removed] p.b.Alone: 0 strong, 0 weak\n" in impact + "\n" and impact.index("p.b.Gone") < impact.index("p.b.Alone")


def test_cycles_of_a_module_and_bounded_word_hits(small):
    assert "\ncycle: p.c -> p.b -> p.c\n" in small.module_dependencies("p.c") + "\n"
    assert "\ncycle: p.b -> p.c -> p.b\n" in small.module_dependencies("p.*") + "\n"
    assert "\ncycles: none\n" in small.module_dependencies("p.a") + "\n"
    found = small.search_symbols("thing")
    assert found.startswith("200+ symbols match thing\n") and "of 200+ not listed" in found and "lists them all" not in found
    assert small.search_symbols("Gone").startswith("1 symbols match Gone\n")


def test_close_scopes_branches_and_the_bound_on_lookups(small, monkeypatch):
    from codelattice import api

    write = lambda text: open(f"{small.root}/p/shopping.py", "w").write(text)  # noqa: E731, SIM115
    write("class Cart:\n    total = 1\n    def add(self): pass\ndef pay(): pass\nCart().add()\n")
    git(small.root, "add", "-A")
    git(small.root, "commit", "-qm", "two")
    git(small.root, "branch", "release-1")
    git(small.root, "branch", "zebra")
    write("class Cart:\n    total = 2\n    def add(self, n): pass\n")
    git(small.root, "commit", "-qam", "three")
    small.refresh()
    assert small.search_symbols("x", path="p/shoping.py") == "nothing is indexed under p/shoping.py; similar names: shopping"
    assert "branches: release-1, " in small.diff_impact("relaese-1") and "zebra" in small.diff_impact("relaese-1")
    assert small.diff_impact("HEAD", "--all").startswith("not a commit")
    impact = small.diff_impact("release-1", "HEAD")
    assert "[removed] p.shopping.pay: 0 strong, 0 weak" in impact and "callers are looked up" not in impact
    monkeypatch.setattr(api, "LOOKUPS", 1)
    impact = small.diff_impact("release-1", "HEAD")
    assert "callers are looked up for 1 changed symbols, not for 2 others" in impact
    assert "[removed] p.shopping.pay: 0 strong" in impact and "[signature] p.shopping.Cart.add: callers not looked up" in impact


def test_labels_of_cycles():
    from codelattice.api import cycle_lines

    row = lambda loop, size: {"loop": loop, "size": size}
    long = [f"module_{i:03}" for i in range(60)]
    assert cycle_lines([row(["a", "b", "a"], 2), row(["a", "b", "a"], 3)]) == ["cycle: a -> b -> a", "cycle among 3 modules, e.g. a -> b -> a"]
    text = cycle_lines([row([*long, long[0]], 60)])[0]
    assert text.startswith("cycle among 60 modules, e.g. module_000 -> ") and text.endswith("…")
