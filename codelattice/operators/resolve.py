"""Call sites to the symbols they may call, each with a tier: 3 exact, 2 likely, 1 possible.

Of each call site the best tier stays, with all its candidates, so tiers are found one after the other, each among the call
sites without a candidate of the tiers before. Exact and likely candidates are found by equality alone: what a receiver or a
bound name stands for is the qualified name, owner or module of the symbol; the enclosing types or their bases own it; or the
file can name its owner. Where that takes the names of a whole file, the shorter of two ways is chosen for each name: from its
candidates, or from the names (`_met`). Only call sites without any of these meet all symbols of their name, and all of that join
is result. Rows of call sites that are read again stand in Parquet tables; no list is copied to the call sites of a file. Joins deal
symbols, imports, bindings and call sites by keys; what is broadcast has been counted (`beside`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import apart, beside, few, stored
from ..functions.text import TYPE_KINDS, arity_fits, external_type, is_static, simple_name
from ..sources.model import LABELS
from .hierarchy import ancestors, around

PY_CALLABLE = ("function", "method", "class")
REF = ["path", "ref"]
SITE = [*REF, "line", "col", "name", "receiver", "enclosing_ordinal"]
#: What the tiers still ask of a candidate that was found.
CANDIDATE = ["c_path", "c_ordinal", "c_kind", "c_qualified_name", "c_param_count", "c_is_varargs", "c_owner_kind"]
_DOTTED = r"^(?U)[\w.]+$"


def _way(how: str | Column, key: str | Column) -> Column:
    """A key of candidates, and how it leads to them."""
    return F.struct((F.lit(how) if isinstance(how, str) else how).alias("how"), (F.col(key) if isinstance(key, str) else key).alias("key"))


class Resolver:
    """Facts of an index, and resolve() over its call sites. tables: files, symbols, imports, refs."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.files = beside(tables["files"].select("path", "language", "module"), "files")
        self.imports, symbols = apart(tables["imports"]), apart(tables["symbols"])
        f = self.files
        s = symbols.join(f, "path")
        parents = symbols.select("path", F.col("ordinal").alias("parent_ordinal"), F.col("kind").alias("owner_kind"), F.col("name").alias("owner_name"), F.col("qualified_name").alias("owner_qn"), F.col("parent_ordinal").alias("owner_parent"))
        owned = s.where("parent_ordinal is not null").join(parents, ["path", "parent_ordinal"], "left")
        self.symbols = stored(owned.unionByName(s.where("parent_ordinal is null"), allowMissingColumns=True).drop("decorators", "doc", "name_words"), "symbols")
        self.refs = tables["refs"].withColumnRenamed("ordinal", "ref").join(f, "path")
        self.above = self._above(symbols)
        types = s.where(F.col("kind").isin(*TYPE_KINDS))
        self.types = types.groupBy("language", F.col("qualified_name").alias("t_qn")).agg(
            F.min_by(F.struct("path", "ordinal", "kind", "name", F.transform("bases", simple_name).alias("bases")), F.struct("path", "ordinal")).alias("t")
        )

    @staticmethod
    def _above(symbols: DataFrame) -> DataFrame:
        """(path, node, ancestor, depth, and what is known of the ancestor), each symbol itself included."""
        known = {"kind": "kind", "a_name": "name", "a_qn": "qualified_name", "a_bases": "bases"}
        if all(c in symbols.columns for c in LABELS):
            return around(symbols.select("path", "ordinal", *LABELS, *[F.col(c).alias(name) for name, c in known.items()]), *known)
        closure = ancestors(symbols, ["path"], "parent_ordinal", "ordinal").select("path", "node", "ancestor", "depth")
        own = symbols.select("path", F.col("ordinal").alias("node"), F.col("ordinal").alias("ancestor"), F.lit(0).cast("bigint").alias("depth"))
        kinds = symbols.select("path", F.col("ordinal").alias("ancestor"), *[F.col(c).alias(name) for name, c in known.items()])
        return stored(closure.union(own).join(kinds, ["path", "ancestor"]), "above")

    # --- shared facts -----------------------------------------------------------------------

    def _enclosing(self, refs: DataFrame) -> DataFrame:
        """refs with all enclosing symbols (chain), and of the enclosing types, innermost first, ordinals (ids), qualified names (around) and bases, those of the first one again (own_bases)."""
        is_type = F.col("kind").isin(*TYPE_KINDS)
        item = F.struct("depth", F.col("ancestor").alias("id"), F.col("a_qn").alias("qn"), F.transform("a_bases", simple_name).alias("bases"))
        near = self.above.groupBy("path", F.col("node").alias("enclosing_ordinal")).agg(F.collect_set("ancestor").alias("chain"), F.sort_array(F.collect_list(F.when(is_type, item))).alias("__t"))
        ids, qns = F.transform("__t", lambda c: c["id"]), F.transform("__t", lambda c: c["qn"])
        bases = F.array_distinct(F.flatten(F.filter(F.transform("__t", lambda c: c["bases"]), lambda x: x.isNotNull())))
        near = near.select("path", "enclosing_ordinal", "chain", ids.alias("ids"), qns.alias("around"), bases.alias("bases"), F.get("__t", F.lit(0))["bases"].alias("own_bases"))
        rows = refs.where("enclosing_ordinal is not null").join(near, ["path", "enclosing_ordinal"], "left").unionByName(refs.where("enclosing_ordinal is null"), allowMissingColumns=True)
        return rows.withColumns({c: F.coalesce(c, F.array().cast(near.schema[c].dataType)) for c in ("chain", "ids", "around", "bases", "own_bases")})

    def _named_symbols(self, kinds: tuple[str, ...] | None = None) -> DataFrame:
        """Symbols by (language, want), their name; all columns that the rules ask about start with c_."""
        keep = ["ordinal", "parent_ordinal", "kind", "name", "qualified_name", "signature", "param_count", "is_varargs", "path", "module", "owner_kind", "owner_name", "owner_qn", "owner_parent"]
        s = self.symbols if kinds is None else self.symbols.where(F.col("kind").isin(*kinds))
        return s.select(F.col("language"), F.col("name").alias("want"), *[F.col(c).alias(f"c_{c}") for c in keep])

    @staticmethod
    def _met(asks: DataFrame, scopes: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
        """(on..., name, columns of known): candidates of a name that a scope of the asking place can name.

        asks: (on..., name); scopes: (on..., how, key); known: (name, how, key, ...). Each name is looked up by its candidates
        or by the scopes of its place, whichever are fewer.
        """
        key, columns = ["how", "key"], [c for c in known.columns if c not in ("how", "key")]
        keys = stored(known.select(*key).distinct(), "keys")
        if few(keys):
            scopes = scopes.join(F.broadcast(keys), key, "left_semi")
        scopes = beside(scopes.distinct(), "scopes")
        known = apart(known.join(scopes.select(*key).distinct(), key, "left_semi"))
        wide, many = beside(scopes.groupBy(*on).agg(F.count("*").alias("__scopes")), "wide"), beside(known.groupBy("name").agg(F.count("*").alias("__known")), "many")
        asks = stored(asks.distinct().join(many, "name").join(wide, on), "asks")
        by_name = asks.where("__known <= __scopes").join(known, "name").join(scopes, [*on, *key], "left_semi")
        by_scope = asks.where("__known > __scopes").join(scopes, on).join(known, ["name", *key])
        return by_name.select(*on, *columns).union(by_scope.select(*on, *columns)).distinct()

    def _not_in(self, rows: DataFrame, *found: DataFrame) -> DataFrame:
        """rows of call sites that have no candidate in found."""
        for x in found:
            rows = rows.join(x.select(*REF).distinct(), REF, "left_anti")
        return rows

    def _type(self, rows: DataFrame, qn: str, language: str, prefix: str) -> DataFrame:
        """rows with prefix_path, _ordinal, _kind, _bases of the type named by column qn."""
        t = self.types.where(F.col("language") == language).select(F.col("t_qn").alias(qn), *[F.col(f"t.{c}").alias(f"{prefix}_{c}") for c in ("path", "ordinal", "kind", "bases")])
        return rows.join(t, qn, "left")

    # --- Python -------------------------------------------------------------------------------

    def bindings(self) -> DataFrame:
        """(path, local, target): names of a Python file; its own definitions before its imports, the last of each."""
        py = self.files.where("language = 'python'").select("path")
        i = self.imports.join(py, "path").where("name is null or name <> '*'")
        first = F.substring_index("module", ".", 1)
        local = F.when(F.col("name").isNull(), F.coalesce("alias", first)).otherwise(F.coalesce("alias", "name"))
        target = F.when(F.col("name").isNull(), F.when(F.col("alias").isNotNull(), F.col("module")).otherwise(first)).otherwise(F.concat_ws(".", "module", "name"))
        rows = i.select("path", local.alias("local"), target.alias("target"), F.lit(0).alias("own"), "ordinal")
        top = self.symbols.where("language = 'python' and parent_ordinal is null").select("path", F.col("name").alias("local"), F.col("qualified_name").alias("target"), F.lit(1).alias("own"), "ordinal")
        return rows.unionByName(top).groupBy("path", "local").agg(F.max_by("target", F.struct("own", "ordinal")).alias("target"))

    def followed(self, rows: DataFrame, dotted: str, out: str) -> DataFrame:
        """rows with `out`: what column dotted re-exports, one level deep; itself if it is a symbol or module."""
        ask = rows.select(F.col(dotted).alias("__d")).where("__d is not null").distinct()
        known = self.symbols.where("language = 'python'").select(F.col("qualified_name").alias("__d")).union(self.files.where("language = 'python'").select("module")).distinct().withColumn("__known", F.lit(True))
        known = apart(known)
        py = self.files.where("language = 'python'").select("path", F.col("module").alias("__m"))
        i = self.imports.where("name is not null and name <> '*'").join(py, "path").select("__m", F.coalesce("alias", "name").alias("__n"), F.concat_ws(".", "module", "name").alias("__to"), "path", "ordinal")
        i = apart(i.groupBy("__m", "__n").agg(F.min_by("__to", F.struct("path", "ordinal")).alias("__to")))
        got = ask.join(known, "__d", "left").withColumns({"__m": F.when(F.instr("__d", ".") > 0, F.regexp_replace("__d", r"\.[^.]*$", "")).otherwise(""), "__n": F.substring_index("__d", ".", -1)})
        got = got.join(i, ["__m", "__n"], "left").select(F.col("__d").alias(dotted), F.when(F.col("__known").isNull() & F.col("__to").isNotNull(), F.col("__to")).otherwise(F.col("__d")).alias(out))
        return rows.join(apart(got), dotted, "left")

    def python(self, refs: DataFrame) -> DataFrame:
        refs = refs.where("language = 'python'")
        b = stored(self.followed(self.bindings(), "target", "to"), "bindings")
        s = self._named_symbols(PY_CALLABLE).where("language = 'python'").drop("language", "want")
        inner = F.coalesce(F.col("c_owner_kind").isin("function", "method"), F.lit(False))
        top, below = s.where("c_parent_ordinal is null"), s.where("c_parent_ordinal is not null")
        stars = beside(self.imports.where("name = '*'").select("path", F.col("module").alias("c_module")).distinct(), "stars")
        bare = self._python_bare(refs.where("receiver is null"), b, top, below.where(inner), stars)
        return bare.unionByName(self._python_received(refs.where("receiver is not null"), b, top, below.where(~inner), stars))

    def _python_bare(self, refs: DataFrame, b: DataFrame, top: DataFrame, nested: DataFrame, stars: DataFrame) -> DataFrame:
        """Calls of a name alone: what it is bound to, functions of the functions around it; if it is not bound, what all names of a module bring, and any function at the top of a module."""
        known = b.join(top.drop("c_name"), b["to"] == top["c_qualified_name"], "left").select("path", F.col("local").alias("name"), "to", F.lit(True).alias("bound"), *CANDIDATE)
        rows = stored(refs.join(known, ["path", "name"], "left"), "bare")
        bound = self._out(rows.where("c_path is not null"), 3)
        inside = self._enclosing(rows.where("enclosing_ordinal is not null").select(*SITE, "to").distinct())
        inside = inside.withColumn("want", F.explode(F.array_distinct(F.filter(F.array("name", F.substring_index("to", ".", -1)), lambda x: x.isNotNull()))))
        inside = inside.withColumns({"c_path": F.col("path"), "c_parent_ordinal": F.explode("chain"), "c_name": F.col("want")})
        inside = stored(self._out(inside.join(nested, ["c_path", "c_parent_ordinal", "c_name"]), 3), "nested")
        free = rows.where("bound is null").select(*SITE)
        free = free.where("enclosing_ordinal is null").unionByName(self._not_in(free.where("enclosing_ordinal is not null"), inside))
        of_name = free["name"] == top["c_name"]
        starred = stored(self._out(free.join(stars, "path").join(top.withColumnRenamed("c_name", "name"), ["c_module", "name"]), 2), "starred")
        return bound.unionByName(inside).unionByName(starred).unionByName(self._out(self._not_in(free, starred).join(top, of_name), 1))

    def _python_targets(self, refs: DataFrame, b: DataFrame) -> DataFrame:
        """(path, receiver, what it stands for, followed; whether that is a type or a module, and the bases of the type) of receivers that begin with a bound name."""
        asks = beside(refs.select("path", "receiver").where(F.col("receiver").rlike(_DOTTED)).distinct(), "receivers").withColumn("local", F.substring_index("receiver", ".", 1))
        rest = F.substring("receiver", F.length("local") + 1, F.length("receiver"))
        rows = asks.join(b, ["path", "local"]).select("path", "receiver", F.concat("target", rest).alias("target"))
        rows = self._type(self.followed(rows, "target", "target_to"), "target_to", "python", "tt")
        modules = self.files.where("language = 'python'").select(F.col("module").alias("target_to")).distinct().withColumn("is_module", F.lit(True))
        return beside(rows.join(modules, "target_to", "left").select("path", "receiver", "target", "target_to", F.col("tt_path").isNotNull().alias("is_type"), "tt_bases", "is_module"), "targets")

    def _members(self, top: DataFrame, methods: DataFrame) -> DataFrame:
        """(how, key, name, candidate): exact members of a target: of a module or class by its followed name, of anything by its full name, and what a module passes on."""
        of = lambda rows, how, key: rows.select(F.lit(how).alias("how"), key.alias("key"), F.col("c_name").alias("name"), *CANDIDATE)
        full = top.where(F.endswith("c_qualified_name", F.concat(F.lit("."), F.col("c_name"))))
        prefix = F.expr("left(c_qualified_name, length(c_qualified_name) - length(c_name) - 1)")
        py = self.files.where("language = 'python'").select("path", F.col("module").alias("__m"))
        again = self.imports.where("name is not null and name <> '*'").join(py, "path").select("__m", F.coalesce("alias", "name").alias("__n"), F.concat_ws(".", "__m", F.coalesce("alias", "name")).alias("__d")).distinct()
        again = self.followed(again, "__d", "__to").where("__to <> __d")
        again = again.join(top, (again["__to"] == top["c_qualified_name"]) & (again["__n"] == top["c_name"]))
        return of(top, "followed", F.col("c_module")).union(of(methods, "method", F.col("c_owner_qn"))).union(of(full, "full", prefix)).union(of(again, "full", F.col("__m")))

    def _python_received(self, refs: DataFrame, b: DataFrame, top: DataFrame, methods: DataFrame, stars: DataFrame) -> DataFrame:
        """Calls with a receiver: members of what it stands for, methods of the types around it and of their bases, methods that the file can name, and any method."""
        own, super_ = F.col("receiver").isin("self", "cls"), F.startswith("receiver", F.lit("super("))
        within = own | super_
        rows = self._enclosing(refs.where(within)).drop("chain", "around").unionByName(refs.where(~within), allowMissingColumns=True)
        rows = rows.join(self._python_targets(refs, b), ["path", "receiver"], "left")
        rows = stored(rows.select(*SITE, "module", "ids", "bases", "own_bases", "target", "target_to", "is_type", "tt_bases", "is_module"), "received")
        ways = F.array(_way("followed", "target_to"), _way("full", "target"), _way(F.when(~within, F.lit("method")), "target_to"))
        members = rows.where("target is not null").select(*SITE, F.inline(ways)).join(self._members(top, methods), ["how", "key", "name"])
        mine = rows.where(own).select(*SITE, F.col("path").alias("c_path"), F.explode("ids").alias("c_parent_ordinal"))
        mine = mine.join(methods.withColumnRenamed("c_name", "name"), ["c_path", "c_parent_ordinal", "name"])
        exact = stored(self._out(members, 3).unionByName(self._out(mine, 3)).distinct(), "exact")
        may = own | F.col("target").isNotNull()
        rows = rows.where(~may).unionByName(self._not_in(rows.where(may), exact))
        open_ = ~within & ~F.coalesce("is_type", F.lit(False)) & F.col("is_module").isNull()
        bases = F.when(own, F.col("bases")).when(super_, F.col("own_bases")).when(F.col("is_type"), F.col("tt_bases"))
        of_base = rows.where(~open_).select(*SITE, F.explode(F.array_distinct(bases)).alias("c_owner_name"))
        of_base = of_base.join(methods.withColumnRenamed("c_name", "name"), ["c_owner_name", "name"])
        asking = rows.where(open_)
        likely = stored(self._out(of_base, 2).unionByName(self._out(asking.select(*SITE).join(apart(self._python_seen(asking, b, methods, stars)), ["path", "name"]), 2)), "likely")
        left = self._not_in(rows.where(within | open_).select(*SITE), likely)
        return exact.unionByName(likely).unionByName(self._out(left.join(methods, left["name"] == methods["c_name"]), 1))

    def _python_seen(self, asking: DataFrame, b: DataFrame, methods: DataFrame, stars: DataFrame) -> DataFrame:
        """(path, name, candidate): methods whose class or module the calling file can name, or has all names of, or is itself."""
        parts = F.split("c_module", r"\.")
        prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
        keys = F.array_distinct(F.filter(F.concat(F.array("c_owner_qn"), prefixes), lambda x: x.isNotNull()))
        ways = F.concat(F.transform(keys, lambda k: _way("named", k)), F.array(_way("all", "c_module")))
        known = methods.select(F.col("c_name").alias("name"), *CANDIDATE, F.inline(ways))
        files = beside(asking.select("path", "module").distinct(), "asking")
        scopes = b.select("path", F.lit("named").alias("how"), F.col("to").alias("key")).union(stars.select("path", F.lit("all"), "c_module")).join(files.select("path").distinct(), "path", "left_semi")
        scopes = scopes.union(files.select("path", F.lit("all"), "module"))
        return self._met(asking.select("path", "name"), scopes, known, ["path"])

    # --- Java -----------------------------------------------------------------------------------

    def type_names(self, ask: DataFrame) -> DataFrame:
        """(path, classes, written, named): the type that `written` denotes there; the first rule that hits.

        ask: distinct (path, module, classes, written); classes innermost first, as qualified names.
        """
        ask = ask.where(F.col("written").rlike(_DOTTED)).withColumn("head", F.substring_index("written", ".", 1))
        ask = ask.withColumn("suffix", F.substring("written", F.length("head") + 1, F.length("written")))
        types = self.types.where("language = 'java'").select(F.col("t_qn").alias("qn")).withColumn("ok", F.lit(True))
        key = ["path", "classes", "written"]
        branches = []
        # 1: enclosing classes and their members, from the inside out
        e = ask.select(*key, "head", "suffix", F.posexplode("classes").alias("p", "c"))
        own = e.where(F.substring_index("c", ".", -1) == F.col("head")).select(*key, (F.col("p") * 2).alias("p"), F.concat("c", "suffix").alias("qn"))
        member = e.select(*key, (F.col("p") * 2 + 1).alias("p"), F.concat("c", F.lit("."), "head", "suffix").alias("qn"))
        branches.append(own.union(member).join(types, "qn", "left_semi").select(*key, F.lit(1).alias("rule"), "p", F.col("qn").alias("named")))
        # 2: top-level types of the same file
        top = self.symbols.where(F.col("kind").isin(*TYPE_KINDS)).where("language = 'java' and parent_ordinal is null").select("path", F.col("name").alias("head"), F.col("qualified_name").alias("qn"), F.col("ordinal").alias("p"))
        branches.append(ask.join(top, ["path", "head"]).select(*key, F.lit(2), "p", F.concat("qn", "suffix")))
        # 3: imports of one type, known or not
        i = self.imports.where("not is_static").select("path", F.col("name").alias("head"), F.col("module").alias("m"), F.col("ordinal").alias("p"))
        branches.append(ask.join(i, ["path", "head"]).select(*key, F.lit(3), "p", F.concat("m", F.lit("."), "head", "suffix")))
        # 4: the same package
        same = ask.withColumn("qn", F.when(F.col("module") != "", F.concat_ws(".", "module", "head")).otherwise(F.col("head")))
        branches.append(same.join(types, "qn", "left_semi").select(*key, F.lit(4), F.lit(0), F.concat("qn", "suffix")))
        # 5: wildcard imports
        wild = self.imports.where("not is_static and name = '*'").select("path", F.col("module").alias("m"), F.col("ordinal").alias("p"))
        wild = ask.join(wild, "path").withColumn("qn", F.concat_ws(".", "m", "head"))
        branches.append(wild.join(types, "qn", "left_semi").select(*key, F.lit(5), "p", F.concat("qn", "suffix")))
        # 6: written out in full
        branches.append(ask.withColumn("qn", F.col("written")).join(types, "qn", "left_semi").select(*key, F.lit(6), F.lit(0), "qn"))
        every = branches[0]
        for x in branches[1:]:
            every = every.union(x)
        return every.groupBy(*key).agg(F.min_by("named", F.struct("rule", "p")).alias("named"))

    def _named(self, rows: DataFrame, written: Column, classes: Column, out: str) -> DataFrame:
        rows = rows.withColumns({"__w": written, "__c": classes})
        ask = rows.where("__w is not null").select("path", "module", F.col("__c").alias("classes"), F.col("__w").alias("written")).distinct()
        got = self.type_names(ask).select("path", F.col("classes").alias("__c"), F.col("written").alias("__w"), F.col("named").alias(out))
        got = beside(got, "named")
        return rows.where("__w is not null").join(got, ["path", "__c", "__w"], "left").unionByName(rows.where("__w is null"), allowMissingColumns=True).drop("__w", "__c")

    def java(self, refs: DataFrame) -> DataFrame:
        refs = self._enclosing(refs.where("language = 'java'").withColumn("module", F.coalesce("module", F.lit("")))).drop("chain", "language")
        refs = stored(refs, "java-refs")
        return self._java_calls(refs).unionByName(self._java_new(refs)).unionByName(self._java_constructors(refs))

    def _java_calls(self, refs: DataFrame) -> DataFrame:
        r = F.col("receiver")
        plain = r.isNull() | (r == "this")
        super_ = ~plain & ((r == "super") | F.endswith(r, F.lit(".super")))
        calls = refs.where(F.col("kind").isin("call", "method_ref"))
        calls = self._type(self._named(calls, F.when(~(plain | super_), r), F.col("around"), "named"), "named", "java", "nt")
        calls = stored(calls.select(*SITE, "arg_count", "module", "ids", "around", "bases", "own_bases", "named", "nt_bases"), "java-calls")
        s = self._named_symbols(("method", "field")).where("language = 'java'").drop("language", "want").withColumnRenamed("c_name", "name")
        s = s.where("c_kind = 'method' or c_owner_kind = 'record'").withColumn("c_static", F.coalesce((F.col("c_kind") == "method") & is_static(F.col("c_signature")), F.lit(False)))
        owned, orphans = s.where("c_parent_ordinal is not null"), s.where("c_parent_ordinal is null")
        site = [*SITE, "arg_count"]

        # exact: of the type that the receiver names, of the types around, imported by name or with all of a type
        named = calls.where("named is not null").select(*site, F.col("named").alias("c_owner_qn")).join(owned, ["c_owner_qn", "name"])
        ids = F.when(r.isNull(), F.col("ids")).otherwise(F.slice("ids", 1, 1))
        here = calls.where(plain).select(*site, F.col("path").alias("c_path"), F.explode(ids).alias("c_parent_ordinal")).join(owned, ["c_path", "c_parent_ordinal", "name"])
        static = beside(self.imports.where("is_static").select("path", "name", F.col("module").alias("c_owner_qn")).distinct(), "static")
        bare = calls.where("receiver is null").select(*site)
        imported = bare.join(static, ["path", "name"]).unionByName(bare.join(static.where("name = '*'").drop("name"), "path")).join(owned, ["c_owner_qn", "name"])
        found = [self._java_fit(x, 3) for x in (named, here, imported)]
        exact = stored(found[0].unionByName(found[1]).unionByName(found[2]).distinct(), "exact")

        # likely: of a base of these types, or of a type that the file can name
        rest = self._not_in(calls, exact)
        open_ = ~plain & ~super_ & F.col("named").isNull() & ~external_type(r)
        bases = F.when(plain, F.col("bases")).when(super_, F.col("own_bases")).when(F.col("named").isNotNull(), F.col("nt_bases"))
        of_base = rest.where(~open_).select(*site, F.explode(F.array_distinct(bases)).alias("c_owner_name")).join(owned, ["c_owner_name", "name"])
        asking = rest.where(open_)
        seen = asking.select(*site, "around").join(self._java_seen(asking, owned.where(~F.col("c_static"))), ["path", "around", "name"])
        likely = stored(self._java_fit(of_base, 2).unionByName(self._java_fit(seen, 2)), "likely")

        # possible: any of the name; where the receiver is a type, only what has no owner
        last = self._not_in(rest, likely)
        any_ = last.where(plain | super_ | open_).select(*site).join(s, "name")
        lost = last.where(~(plain | super_ | open_)).select(*site).join(orphans, "name")
        return exact.unionByName(likely).unionByName(self._java_fit(any_, 1)).unionByName(self._java_fit(lost, 1))

    def _java_fit(self, rows: DataFrame, tier: int) -> DataFrame:
        """Of calls with candidates those that fit by their number of arguments; a field fits as the accessor of a record."""
        fits = arity_fits(F.col("arg_count"), F.col("c_param_count"), F.col("c_is_varargs"))
        accessor = (F.col("c_kind") == "field") & (F.coalesce("arg_count", F.lit(0)) == 0) & (F.col("c_owner_kind") == "record")
        return self._out(rows.where(((F.col("c_kind") == "method") & fits) | accessor), tier)

    def _java_seen(self, asking: DataFrame, owned: DataFrame) -> DataFrame:
        """(path, around, name, candidate): candidates whose owner, or a type around it, has its simple name there.

        Each rule of type_names() brings a type by its qualified name ("type") or from what it stands in ("in"); what is found
        so is put to type_names() itself, for rules may hide each other's types.
        """
        outer = self.above.where(F.col("kind").isin(*TYPE_KINDS)).select(F.col("path").alias("c_path"), F.col("node").alias("c_parent_ordinal"), "a_name", "a_qn")
        a_name, a_qn = F.col("a_name"), F.col("a_qn")
        home = F.when(a_qn == a_name, "").when(F.endswith(a_qn, F.concat(F.lit("."), a_name)), F.expr("left(a_qn, length(a_qn) - length(a_name) - 1)"))
        known = owned.join(outer, ["c_path", "c_parent_ordinal"]).select("name", *CANDIDATE, "a_name", "a_qn", F.inline(F.array(_way("type", a_qn), _way("in", home)))).where("key is not null")
        on = ["path", "module", "around"]
        places = stored(asking.select(*on).distinct(), "places")
        around = F.flatten(F.transform("around", lambda c: F.array(_way("type", c), _way("in", c))))
        always = F.array(_way("in", "module"), _way("in", F.lit("")))
        tops = self.symbols.where(F.col("kind").isin(*TYPE_KINDS)).where("language = 'java' and parent_ordinal is null").select("path", F.lit("type").alias("how"), F.col("qualified_name").alias("key"))
        i = self.imports.where("not is_static").select("path", F.when(F.col("name") == "*", F.lit("in")).otherwise(F.lit("type")).alias("how"), F.when(F.col("name") == "*", F.coalesce("module", F.lit(""))).otherwise(F.concat("module", F.lit("."), "name")).alias("key"))
        scopes = places.select(*on, F.inline(F.concat(around, always))).unionByName(places.join(tops.union(i), "path")).where("key is not null")
        met = stored(self._met(asking.select(*on, "name"), scopes, known, on), "met")
        got = self.type_names(met.select("path", "module", F.col("around").alias("classes"), F.col("a_name").alias("written")).distinct())
        got = got.select("path", F.col("classes").alias("around"), F.col("written").alias("a_name"), F.col("named").alias("a_qn"))
        return met.join(apart(got), ["path", "around", "a_name", "a_qn"], "left_semi").select("path", "around", "name", *CANDIDATE).distinct()

    def _java_new(self, refs: DataFrame) -> DataFrame:
        new = self._named(refs.where("kind = 'new'"), F.concat_ws(".", "receiver", "name"), F.col("around"), "named").select(*SITE, "arg_count", "named")
        made = F.col("c_kind") == "constructor"
        s = self._named_symbols((*TYPE_KINDS, "constructor")).where("language = 'java'").drop("language", "want").withColumnRenamed("c_name", "name")
        s = s.withColumn("of", F.when(made, F.col("c_owner_qn")).otherwise(F.col("c_qualified_name")))
        fits = ~made | arity_fits(F.col("arg_count"), F.col("c_param_count"), F.col("c_is_varargs"))
        exact = new.where("named is not null").withColumnRenamed("named", "of").join(s, ["of", "name"]).where(fits)
        unknown = new.where("named is null").join(s, "name").where(fits)
        return self._out(exact, 3).unionByName(self._out(unknown, 1))

    def _java_constructors(self, refs: DataFrame) -> DataFrame:
        calls = refs.where("kind = 'constructor_call'").where(F.size("ids") > 0)
        own = calls.where("name = 'this'").withColumns({"o_path": F.col("path"), "o_ordinal": F.get("ids", F.lit(0))})
        base = calls.where("name <> 'this'").withColumn("__b", F.explode("own_bases"))
        base = self._named(base, F.col("__b"), F.slice("around", F.lit(2), F.greatest(F.size("around") - 1, F.lit(0))), "named")
        base = self._type(base, "named", "java", "o").where("o_kind = 'class'")
        both = own.select(*refs.columns, "o_path", "o_ordinal").unionByName(base.select(*refs.columns, "o_path", "o_ordinal"))
        makers = self.symbols.where("kind = 'constructor'").select(F.col("path").alias("o_path"), F.col("parent_ordinal").alias("o_ordinal"), *[F.col(c).alias(f"c_{c}") for c in ("path", "ordinal", "qualified_name", "kind", "param_count", "is_varargs")])
        rows = both.join(makers, ["o_path", "o_ordinal"]).where(arity_fits(F.col("arg_count"), F.col("c_param_count"), F.col("c_is_varargs")))
        return self._out(rows, 3).distinct()

    # --- results -----------------------------------------------------------------------------------

    @staticmethod
    def _out(rows: DataFrame, tier: int) -> DataFrame:
        return rows.select(*SITE, "c_path", "c_ordinal", F.col("c_qualified_name").alias("qualified_name"), "c_kind", F.lit(tier).alias("tier"))

    def resolve(self, refs: DataFrame | None = None) -> DataFrame:
        """(path, ref, line, col, name, receiver, enclosing_ordinal, c_path, c_ordinal, qualified_name, c_kind, tier).

        Each candidate of a call site comes once, as call sites have keys of their own; rows that come twice in refs stay so.
        """
        refs = stored(self.refs if refs is None else refs, "refs")
        have = {r["language"] for r in refs.select("language").distinct().collect()}  # a row a language
        if have == {"java"}:
            return self.java(refs)
        found = self.python(refs)
        return found.unionByName(self.java(refs)) if "java" in have else found

    def references(self, target: DataFrame) -> DataFrame:
        """Call sites of the symbols (path, ordinal) in target, best tier first.

        Call sites are narrowed by name before they are resolved, candidates are not: the best tier is decided among all.
        """
        target = beside(target.select("path", "ordinal"), "wanted")
        t = self.symbols.join(target, ["path", "ordinal"], "left_semi")
        names = t.select("language", "name")
        py = self.files.where("language = 'python'").select("path")
        aliases = self.imports.where("alias is not null").join(py, "path").join(t.where("language = 'python'").select("name").distinct(), "name").select(F.lit("python"), "alias")
        names = beside(names.union(aliases).distinct(), "wanted-names")
        refs = self.refs.join(names, ["language", "name"], "left_semi")
        maker = t.where("kind = 'constructor'").select("language").distinct()
        more = self.refs.where("kind = 'constructor_call'").join(maker, "language", "left_semi").join(names, ["language", "name"], "left_anti")
        found = self.resolve(refs.unionByName(more.select(*refs.columns)))
        hit = found.join(target.select(F.col("path").alias("c_path"), F.col("ordinal").alias("c_ordinal")), ["c_path", "c_ordinal"], "left_semi")
        return hit.orderBy(F.desc("tier"), "path", "line", "col")
