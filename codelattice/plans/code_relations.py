"""Code relations made of the Parquet tables, and the resolver itself run over them.

Functions, methods, classes, imports and call sites follow from keys by fixed rules, so that SQL can say
which candidate each rule of the resolver must choose. Names have eight candidates at every scale, in
different files, as names in a code base have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import apart
from ..operators import graph
from ..operators.resolve import Resolver
from ..sources.model import LABELS, TABLES

QUERIES: dict = {}
ORACLES: dict = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _relation(rows: DataFrame, relation: str, /, **columns: str) -> DataFrame:
    """rows as a relation of the index; columns by SQL expressions, null where none is given."""
    made = []
    for part in TABLES[relation].split(", "):
        column, kind = part.split(" ", 1)
        if column in LABELS:  # these ordinals don't number trees
            continue
        default = "false" if kind == "boolean" else "array()" if kind.startswith("array") else "null"
        made.append(F.expr(f"cast({columns.get(column, default)} as {kind})").alias(column))
    return rows.select(*made)


def _union(*rows: DataFrame) -> DataFrame:
    out = rows[0]
    for x in rows[1:]:
        out = out.unionByName(x)
    return out


def _answer(found: DataFrame) -> DataFrame:
    return found.select("path", F.col("ref").cast("bigint").alias("ref"), "qualified_name", "c_kind", F.col("tier").cast("bigint").alias("tier")).distinct()


_BEST = "SELECT DISTINCT path, ref, qualified_name, c_kind, tier FROM cand WHERE tier IS NOT NULL QUALIFY tier = max(tier) OVER (PARTITION BY path, ref)"

# --- Python: functions, bindings, modules ----------------------------------------------------------------

_LINES = "row_number() over (partition by l_suppkey % 25 order by l_orderkey, l_linenumber, l_partkey, l_suppkey)"
_FUNCTIONS = f"""fn AS (SELECT p_partkey AS p, p_partkey % 25 AS k, 'f' || (p_partkey // 8) AS name, 'pkg.n' || (p_partkey % 25) || '.f' || (p_partkey // 8) AS qualified_name FROM part),
imp AS (SELECT c_nationkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'g' ELSE 'f' END || (c_custkey // 8) AS local, qualified_name AS target, 0 AS own, c_custkey AS ordinal FROM customer JOIN fn ON p = c_custkey),
again AS (SELECT k, local, arg_min(target, ordinal) AS passed_on FROM imp WHERE NOT EXISTS (SELECT 1 FROM fn WHERE fn.k = imp.k AND fn.name = local) GROUP BY k, local),
bind AS (SELECT k, local, arg_max(target, (own, ordinal)) AS target FROM (SELECT * FROM imp
  UNION ALL SELECT k, name, qualified_name, 1, p FROM fn) GROUP BY k, local),
calls AS (SELECT l_suppkey % 25 AS k, {_LINES} AS ref, CASE WHEN l_linenumber % 2 = 1 THEN 'f' ELSE 'g' END || (l_partkey // 8) AS name, CASE WHEN l_linenumber > 4 THEN 'other' WHEN l_linenumber > 2 THEN 'near' END AS receiver FROM lineitem),
cand AS (SELECT 'pkg/n' || c.k || '.py' AS path, ref, qualified_name, 'function' AS c_kind,
  CASE WHEN receiver IS NULL AND target IS NOT NULL THEN CASE WHEN target = qualified_name THEN 3 END WHEN receiver IS NULL THEN CASE WHEN c.k % 5 = 0 AND fn.k = (c.k + 1) % 25 THEN 2 ELSE 1 END
    WHEN receiver = 'near' AND (fn.k = (c.k + 2) % 25 OR passed_on = qualified_name) THEN 3 END AS tier
  FROM calls c LEFT JOIN bind b ON receiver IS NULL AND b.k = c.k AND b.local = c.name LEFT JOIN again a ON a.k = (c.k + 2) % 25 AND a.local = c.name JOIN fn ON fn.name = coalesce(string_split(target, '.')[3], c.name) OR fn.name = c.name)"""


def python_functions(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """A file for each nation, a function for each part, imports of functions, of a module and of all of a module, a call for each line."""
    nations, parts = _read(spark, d, "nation"), _read(spark, d, "part")
    files = _relation(nations, "files", path="concat('pkg/n', n_nationkey, '.py')", language="'python'", module="concat('pkg.n', n_nationkey)")
    name, home = "concat('f', p_partkey div 8)", "concat('pkg.n', p_partkey % 25)"
    symbols = _relation(parts, "symbols", path="concat('pkg/n', p_partkey % 25, '.py')", ordinal="p_partkey", kind="'function'", name=name, qualified_name=f"concat({home}, '.', {name})", signature=f"concat('def ', {name}, '()')", param_count="0")
    named = _read(spark, d, "customer").join(apart(parts), F.col("c_custkey") == F.col("p_partkey"), "left_semi")
    one = _relation(named, "imports", path="concat('pkg/n', c_nationkey, '.py')", ordinal="c_custkey", module="concat('pkg.n', c_custkey % 25)", name="concat('f', c_custkey div 8)", alias="case when c_custkey % 3 = 0 then concat('g', c_custkey div 8) end", line="1")
    every = _relation(nations.where("n_nationkey % 5 = 0"), "imports", path="concat('pkg/n', n_nationkey, '.py')", ordinal="-2", module="concat('pkg.n', (n_nationkey + 1) % 25)", name="'*'", line="1")
    module = _relation(nations, "imports", path="concat('pkg/n', n_nationkey, '.py')", ordinal="-1", module="concat('pkg.n', (n_nationkey + 2) % 25)", alias="'near'", line="1")
    refs = _relation(
        _read(spark, d, "lineitem"), "refs", path="concat('pkg/n', l_suppkey % 25, '.py')", ordinal=_LINES, kind="'call'", name="concat(case when l_linenumber % 2 = 1 then 'f' else 'g' end, l_partkey div 8)",
        receiver="case when l_linenumber > 4 then 'other' when l_linenumber > 2 then 'near' end", arg_count="0", line="l_orderkey", col="l_linenumber",
    )
    return {"files": files, "symbols": symbols, "imports": _union(one, every, module), "refs": refs}


@_query(f"WITH {_FUNCTIONS} {_BEST}")
def resolve_python_functions(spark, d):
    return _answer(Resolver(python_functions(spark, d)).resolve())


@_query(f"WITH {_FUNCTIONS} SELECT * FROM ({_BEST}) WHERE qualified_name = 'pkg.n17.f2'")
def references_of_function(spark, d):
    t = python_functions(spark, d)
    return _answer(Resolver(t).references(t["symbols"].where("qualified_name = 'pkg.n17.f2'").select("path", "ordinal")))


@_query("""SELECT path, local, target FROM (SELECT 'pkg/n' || k || '.py' AS path, local, target FROM bind UNION ALL SELECT 'pkg/n' || n_nationkey || '.py', 'near', 'pkg.n' || ((n_nationkey + 2) % 25) FROM nation)""".join([f"WITH {_FUNCTIONS} ", ""]))
def python_bindings(spark, d):
    return Resolver(python_functions(spark, d)).bindings()


@_query("""SELECT DISTINCT 'pkg/n' || c_nationkey || '.py' AS path, c_custkey AS ordinal, 'pkg.n' || (c_custkey % 25) AS target FROM customer JOIN part ON p_partkey = c_custkey
UNION ALL SELECT 'pkg/n' || n_nationkey || '.py', -2, 'pkg.n' || ((n_nationkey + 1) % 25) FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'pkg/n' || n_nationkey || '.py', -1, 'pkg.n' || ((n_nationkey + 2) % 25) FROM nation""")
def import_targets(spark, d):
    t = python_functions(spark, d)
    imports = t["imports"].join(t["files"].select("path", "language"), "path")
    found = graph.import_targets(imports, t["files"].select("module"), t["symbols"].select("qualified_name", F.lit("").alias("module"), "path", "ordinal"))
    return found.select("path", F.col("ordinal").cast("bigint").alias("ordinal"), "target")


# --- Python and Java: classes, methods, receivers -----------------------------------------------------------

#: A class for each supplier, with the base of half its number; methods of parts stand in the first ten classes, called by orders.
_METHODS = """sup AS (SELECT s_suppkey AS s, s_nationkey AS k, 'Shop' || s_suppkey AS cls, 'Shop' || (s_suppkey // 2) AS base FROM supplier),
met AS (SELECT p_partkey AS p, s, k, cls, base, 'm' || (p_partkey // 8) AS name, p_size % 3 AS params, p_size % 7 = 0 AS varargs, p_partkey % 2 = 1 AS static FROM part JOIN sup ON s = p_partkey % 10 + 1),
calls AS (SELECT o_orderkey AS o, 'm' || ((o_custkey + o_orderkey % 24) // 8) AS name, s, k, cls, base, o_orderkey % 3 AS args, 'Shop' || (o_custkey % 10 + 1) AS typed, o_orderkey FROM orders JOIN met ON p = o_custkey)"""

_SELF = f"""WITH {_METHODS}, cand AS (SELECT 'shop/n' || c.k || '.py' AS path, o AS ref, 'shop.n' || m.k || '.' || m.cls || '.' || m.name AS qualified_name, 'method' AS c_kind,
  CASE o % 3 WHEN 0 THEN CASE WHEN m.s = c.s THEN 3 WHEN m.cls = c.base THEN 2 ELSE 1 END WHEN 1 THEN CASE WHEN m.cls = c.base THEN 2 ELSE 1 END ELSE CASE WHEN m.k = c.k THEN 2 ELSE 1 END END AS tier
  FROM calls c JOIN met m ON m.name = c.name)"""


def _shops(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(suppliers, parts with the supplier whose class has them as a method, orders with the method that makes the call)."""
    suppliers = _read(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    ten = F.broadcast(suppliers.where("s_suppkey between -8 and 10"))  # what p_partkey % 10 + 1 can be
    methods = _read(spark, d, "part").join(ten, F.expr("s_suppkey = p_partkey % 10 + 1"))
    return suppliers, methods, _read(spark, d, "orders").join(apart(methods), F.col("o_custkey") == F.col("p_partkey"))


_CALLED = "concat('m', (o_custkey + o_orderkey % 24) div 8)"


@_query(f"{_SELF} {_BEST}")
def resolve_python_methods(spark, d):
    suppliers, methods, calls = _shops(spark, d)
    path, home = "concat('shop/n', s_nationkey, '.py')", "concat('shop.n', s_nationkey, '.Shop', s_suppkey)"
    files = _relation(_read(spark, d, "nation"), "files", path="concat('shop/n', n_nationkey, '.py')", language="'python'", module="concat('shop.n', n_nationkey)")
    classes = _relation(suppliers, "symbols", path=path, ordinal="s_suppkey", kind="'class'", name="concat('Shop', s_suppkey)", qualified_name=home, bases="array(concat('Shop', s_suppkey div 2))")
    own = _relation(methods, "symbols", path=path, ordinal="10000000 + p_partkey", parent_ordinal="s_suppkey", kind="'method'", name="concat('m', p_partkey div 8)", qualified_name=f"concat({home}, '.m', p_partkey div 8)")
    refs = _relation(calls, "refs", path=path, ordinal="o_orderkey", enclosing_ordinal="10000000 + p_partkey", kind="'call'", name=_CALLED, receiver="element_at(array('self', 'super()', 'obj'), int(o_orderkey % 3) + 1)", line="1", col="1")
    none = _relation(suppliers.limit(0), "imports")
    return _answer(Resolver({"files": files, "symbols": _union(classes, own), "imports": none, "refs": refs}).resolve())


#: Receivers by order: none, this, super, a type, a variable, and one in seven creates an object.
_JAVA = f"""WITH {_METHODS}, named AS (SELECT c.s AS from_s, t.s AS to_s FROM sup c JOIN sup t ON t.s = c.s OR t.s = c.s * 3 % 10 + 1 OR t.k = c.k),
site AS (SELECT c.*, CASE WHEN o % 7 = 0 THEN 'new' ELSE 'call' END AS kind, o % 5 AS r, t.s AS typed_s, t.base AS typed_base, n.to_s IS NOT NULL AS known
  FROM calls c JOIN sup t ON t.cls = c.typed LEFT JOIN (SELECT DISTINCT * FROM named) n ON n.from_s = c.s AND n.to_s = t.s),
cand AS (SELECT 'n' || c.k || '/' || c.cls || '.java' AS path, o AS ref, 'n' || m.k || '.' || m.cls || '.' || m.name AS qualified_name, 'method' AS c_kind,
  CASE r WHEN 0 THEN CASE WHEN m.s = c.s THEN 3 WHEN m.cls = c.base THEN 2 ELSE 1 END WHEN 1 THEN CASE WHEN m.s = c.s THEN 3 WHEN m.cls = c.base THEN 2 ELSE 1 END WHEN 2 THEN CASE WHEN m.cls = c.base THEN 2 ELSE 1 END
    WHEN 3 THEN CASE WHEN NOT known THEN NULL WHEN m.s = typed_s THEN 3 WHEN m.cls = typed_base THEN 2 END
    ELSE CASE WHEN m.static THEN 1 WHEN EXISTS (SELECT 1 FROM named n WHERE n.from_s = c.s AND n.to_s = m.s) THEN 2 ELSE 1 END END AS tier
  FROM site c JOIN met m ON m.name = c.name WHERE c.kind = 'call' AND CASE WHEN varargs THEN args >= params - 1 ELSE args = params END
  UNION ALL SELECT 'n' || c.k || '/' || c.cls || '.java', o, 'n' || t.k || '.' || t.cls || x.tail, x.kind, CASE WHEN x.kind = 'constructor' AND args <> t.s % 3 THEN NULL WHEN known THEN 3 ELSE 1 END
  FROM site c JOIN sup t ON t.s = typed_s CROSS JOIN (VALUES ('', 'class'), ('.' || 'new', 'constructor')) AS x(tail, kind) WHERE c.kind = 'new')"""


@_query(f"{_JAVA} {_BEST}")
def resolve_java(spark, d):
    suppliers, methods, calls = _shops(spark, d)
    path, home = "concat('n', s_nationkey, '/Shop', s_suppkey, '.java')", "concat('n', s_nationkey, '.Shop', s_suppkey)"
    files = _relation(suppliers, "files", path=path, language="'java'", module="concat('n', s_nationkey)")
    classes = _relation(suppliers, "symbols", path=path, ordinal="0", kind="'class'", name="concat('Shop', s_suppkey)", qualified_name=home, signature="'class'", bases="array(concat('Shop', s_suppkey div 2))")
    makers = _relation(suppliers, "symbols", path=path, ordinal="1", parent_ordinal="0", kind="'constructor'", name="concat('Shop', s_suppkey)", qualified_name=f"concat({home}, '.new')", signature="'Shop()'", param_count="s_suppkey % 3")
    own = _relation(
        methods, "symbols", path=path, ordinal="10 + p_partkey", parent_ordinal="0", kind="'method'", name="concat('m', p_partkey div 8)", qualified_name=f"concat({home}, '.m', p_partkey div 8)",
        signature="case when p_partkey % 2 = 1 then 'public static void m()' else 'public void m()' end", param_count="p_size % 3", is_varargs="p_size % 7 = 0",
    )
    other = suppliers.select(F.col("s_suppkey").alias("t"), F.col("s_nationkey").alias("tk"))
    imports = _relation(suppliers.join(F.broadcast(other.where("t between -8 and 10")), F.expr("t = s_suppkey * 3 % 10 + 1")), "imports", path=path, ordinal="0", module="concat('n', tk)", name="concat('Shop', t)", line="1")
    new = "o_orderkey % 7 = 0"
    typed = "concat('Shop', o_custkey % 10 + 1)"
    refs = _relation(
        calls, "refs", path=path, ordinal="o_orderkey", enclosing_ordinal="10 + p_partkey", kind=f"case when {new} then 'new' else 'call' end", name=f"case when {new} then {typed} else {_CALLED} end",
        receiver=f"case when {new} then null else element_at(array(null, 'this', 'super', {typed}, 'x'), int(o_orderkey % 5) + 1) end", arg_count="o_orderkey % 3", line="1", col="1",
    )
    return _answer(Resolver({"files": files, "symbols": _union(classes, makers, own), "imports": imports, "refs": refs}).resolve())


# --- nested functions, classes as receivers, constructors, records and the ways to name a type ---------------------


@_query("""WITH c AS (SELECT 'nest/n' || c_nationkey || '.py' AS path, 'nest.n' || c_nationkey || '.' AS home, c_custkey AS c FROM customer)
SELECT path, c * 10 AS ref, home || 'outer' || c || '.helper' AS qualified_name, 'function' AS c_kind, 3 AS tier FROM c UNION ALL SELECT path, c * 10 + 1, home || 'K' || c || '.go', 'method', 3 FROM c
UNION ALL SELECT path, c * 10 + 2, home || 'K' || c || '.go', 'method', 2 FROM c""")
def resolve_python_nested(spark, d):
    """Each customer: a function with a helper inside, a class with a method, and a class derived from it; a helper called from outside has no candidate."""
    rows = _read(spark, d, "customer").select("c_custkey", "c_nationkey")
    path, home, c = "concat('nest/n', c_nationkey, '.py')", "concat('nest.n', c_nationkey)", "c_custkey * 10"
    one = lambda place, kind, name, qn, **more: _relation(rows, "symbols", path=path, ordinal=f"{c} + {place}", kind=f"'{kind}'", name=name, qualified_name=f"concat({home}, '.', {qn})", **more)
    outer, k = "concat('outer', c_custkey)", "concat('K', c_custkey)"
    symbols = _union(
        one(0, "function", outer, outer), one(1, "function", "'helper'", f"concat({outer}, '.helper')", parent_ordinal=c), one(2, "class", k, k),
        one(3, "method", "'go'", f"concat({k}, '.go')", parent_ordinal=f"{c} + 2"), one(4, "class", "concat('D', c_custkey)", "concat('D', c_custkey)", bases=f"array({k})"),
    )
    call = lambda place, name, **more: _relation(rows, "refs", path=path, ordinal=f"{c} + {place}", kind="'call'", name=name, arg_count="0", line="1", col="1", **more)
    refs = _union(call(0, "'helper'", enclosing_ordinal=c), call(1, "'go'", receiver=k), call(2, "'go'", receiver="concat('D', c_custkey)"), call(3, "'helper'"))
    files = _relation(_read(spark, d, "nation"), "files", path="concat('nest/n', n_nationkey, '.py')", language="'python'", module="concat('nest.n', n_nationkey)")
    return _answer(Resolver({"files": files, "symbols": symbols, "imports": _relation(rows.limit(0), "imports"), "refs": refs}).resolve())


@_query("""WITH s AS (SELECT a.s_suppkey AS s, 'mk/A' || a.s_suppkey || '.java' AS path, 'mk.n' || a.s_nationkey || '.A' || a.s_suppkey AS own, 'mk.n' || b.s_nationkey || '.A' || b.s_suppkey AS base FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey // 2)
SELECT path, 1 AS ref, own || '.none' AS qualified_name, 'constructor' AS c_kind, 3 AS tier FROM s UNION ALL SELECT path, 2, base || '.some', 'constructor', 3 FROM s""")
def resolve_java_constructors(spark, d):
    """A class for each supplier, with the base of half its number: `this()` of one constructor, `super(...)` with the base's number of arguments of the other."""
    suppliers = _read(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    base = suppliers.select(F.col("s_suppkey").alias("b"), F.col("s_nationkey").alias("bk"))
    path, home, name = "concat('mk/A', s_suppkey, '.java')", "concat('mk.n', s_nationkey, '.A', s_suppkey)", "concat('A', s_suppkey)"
    files = _relation(suppliers, "files", path=path, language="'java'", module="concat('mk.n', s_nationkey)")
    maker = lambda ordinal, last, params: _relation(suppliers, "symbols", path=path, ordinal=ordinal, parent_ordinal="0", kind="'constructor'", name=name, qualified_name=f"concat({home}, '.{last}')", param_count=params)
    classes = _relation(suppliers, "symbols", path=path, ordinal="0", kind="'class'", name=name, qualified_name=home, bases="array(concat('A', s_suppkey div 2))")
    imports = _relation(suppliers.join(apart(base), F.expr("b = s_suppkey div 2 and b <> s_suppkey")), "imports", path=path, ordinal="0", module="concat('mk.n', bk)", name="concat('A', b)", line="1")
    call = lambda ordinal, word, inside, args: _relation(suppliers, "refs", path=path, ordinal=ordinal, enclosing_ordinal=inside, kind="'constructor_call'", name=f"'{word}'", arg_count=args, line="1", col="1")
    refs = _union(call("1", "this", "2", "0"), call("2", "super", "1", "1 + s_suppkey div 2 % 2"))
    symbols = _union(classes, maker("1", "none", "0"), maker("2", "some", "1 + s_suppkey % 2"))
    return _answer(Resolver({"files": files, "symbols": symbols, "imports": imports, "refs": refs}).resolve())


@_query("""SELECT 'use/C' || c_custkey || '.java' AS path, c_custkey AS ref, 'rec.n' || s_nationkey || '.R' || s_suppkey || CASE c_custkey % 5 WHEN 4 THEN '.size' ELSE '.make' END AS qualified_name,
  CASE c_custkey % 5 WHEN 4 THEN 'field' ELSE 'method' END AS c_kind, CASE c_custkey % 5 WHEN 4 THEN 2 ELSE 3 END AS tier FROM customer JOIN supplier ON s_suppkey = c_custkey % 10""")
def resolve_java_names(spark, d):
    """A record for each supplier and a call for each customer: by a static import of a name or of all, a type of an imported package, a type written in full, and a record's accessor."""
    suppliers = _read(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    ten = F.broadcast(suppliers.where("s_suppkey between -9 and 9"))  # what c_custkey % 10 can be
    calls = _read(spark, d, "customer").select("c_custkey").join(ten, F.expr("s_suppkey = c_custkey % 10"))
    record, package, use = "concat('R', s_suppkey)", "concat('rec.n', s_nationkey)", "concat('use/C', c_custkey, '.java')"
    home, own = f"concat({package}, '.', {record})", "concat('rec/R', s_suppkey, '.java')"
    files = _union(_relation(suppliers, "files", path=own, language="'java'", module=package), _relation(calls, "files", path=use, language="'java'", module="'use'"))
    member = lambda ordinal, kind, name, signature, params: _relation(suppliers, "symbols", path=own, ordinal=ordinal, parent_ordinal="0", kind=f"'{kind}'", name=f"'{name}'", qualified_name=f"concat({home}, '.{name}')", signature=f"'{signature}'", param_count=params)
    symbols = _union(
        _relation(suppliers, "symbols", path=own, ordinal="0", kind="'record'", name=record, qualified_name=home), member("1", "method", "make", "public static void make()", "0"), member("2", "field", "size", "int size", "null"),
        _relation(calls, "symbols", path=use, ordinal="0", kind="'class'", name="concat('C', c_custkey)", qualified_name="concat('use.C', c_custkey)"),
    )
    way = "int(c_custkey % 5) + 1"
    imports = _relation(
        calls.where("c_custkey % 5 <> 3"), "imports", path=use, ordinal="0", line="1", is_static="c_custkey % 5 < 2",
        module=f"element_at(array({home}, {home}, {package}, null, {package}), {way})", name=f"element_at(array('make', '*', '*', null, {record}), {way})",
    )
    refs = _relation(
        calls, "refs", path=use, ordinal="c_custkey", enclosing_ordinal="0", kind="'call'", arg_count="0", line="1", col="1", name="if(c_custkey % 5 = 4, 'size', 'make')",
        receiver=f"element_at(array(null, null, {record}, {home}, 'x'), {way})",
    )
    return _answer(Resolver({"files": files, "symbols": symbols, "imports": imports, "refs": refs}).resolve())
