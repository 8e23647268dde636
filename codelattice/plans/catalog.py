"""Named queries over the Parquet tables, and the SQL that must give the same rows.

The tables hold no source code, so each operator runs on the closest relation: documents stand for files
(path = source/lang/doc_id), events for commits and call sites, lineitem for references,
parts and suppliers for candidates, nations for modules. Each query covers its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lineage import shared_folder
from ..operators import graph, hierarchy, history, ranking, search, summaries, versions

QUERIES: dict = {}
ORACLES: dict = {}


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _path():
    return F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))


PATH = "source || '/' || lang || '/' || CAST(doc_id AS VARCHAR)"
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


# --- predicates and projections ---------------------------------------------------------


@_query("SELECT p_partkey, p_name FROM part WHERE p_name = 'red bolt'")
def exact_lookup(spark, d):
    parts = _read(spark, d, "part").withColumns({"name": F.col("p_name"), "qualified_name": F.concat_ws(".", "p_brand", "p_name")})
    return search.exact(parts, "red bolt").select("p_partkey", "p_name")


@_query(f"SELECT doc_id, {PATH} AS path FROM documents WHERE ends_with('/' || {FOLD.format(PATH)}, '/en/7') OR ends_with('/' || {FOLD.format(PATH)}, '/7')")
def suffix_lookup_ci(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", _path().alias("path"))
    return docs.where(X.path_suffix(F.col("path"), "EN/7") | X.path_suffix(F.col("path"), "7"))


@_query("SELECT p_partkey, p_brand || '.' || p_type AS qualified FROM part WHERE p_brand || '.' || p_type = 'promo' OR ends_with(translate(p_brand || '.' || p_type, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.promo')")
def dotted_lookup_ci(spark, d):
    parts = _read(spark, d, "part").select("p_partkey", F.concat_ws(".", "p_brand", "p_type").alias("qualified"))
    return parts.where(X.dotted_suffix(F.col("qualified"), "Promo"))


@_query(f"SELECT doc_id FROM documents WHERE contains('/' || {PATH}, '/en/') OR ends_with('/' || {PATH}, '/en.java') OR ends_with('/' || {PATH}, '/en.py')")
def scope_path(spark, d):
    docs = _read(spark, d, "documents")
    return docs.where(X.in_scope(_path(), F.lit(""), "EN/")).select("doc_id")


@_query("SELECT doc_id FROM documents WHERE contains('.' || source || '.' || lang || '.', '.src1.fr.') OR contains('.' || source || '.' || lang || '.', '.de.')")
def scope_module(spark, d):
    module = F.concat_ws(".", "source", "lang")
    docs = _read(spark, d, "documents")
    return docs.where(X.in_scope(F.lit(""), module, "Src1.FR.*") | X.in_scope(F.lit(""), module, "de")).select("doc_id")


@_query("""SELECT doc_id, path, list_has_any(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1), ['test', 'tests', 'testing', 'it'])
  OR regexp_matches(list_extract(string_split(path, '/'), -1), '^(test_.*\\.py|.*_test\\.py|conftest\\.py|.*(Test|Tests|IT)\\.java)$') AS is_test
FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'tests/' || source || '.py' WHEN 1 THEN lang || '/test_' || source || '.py' WHEN 2 THEN source || '/' || lang || 'Test.java' WHEN 3 THEN 'it.py' ELSE source || '/' || lang || '.py' END AS path FROM documents)""")
def test_path_flag(spark, d):
    k = F.col("doc_id") % 5
    path = (
        F.when(k == 0, F.concat(F.lit("tests/"), "source", F.lit(".py"))).when(k == 1, F.concat("lang", F.lit("/test_"), "source", F.lit(".py")))
        .when(k == 2, F.concat("source", F.lit("/"), "lang", F.lit("Test.java"))).when(k == 3, F.lit("it.py")).otherwise(F.concat("source", F.lit("/"), "lang", F.lit(".py")))
    )
    docs = _read(spark, d, "documents").select("doc_id", path.alias("path"))
    return docs.withColumn("is_test", X.is_test_path(F.col("path")))


@_query("SELECT event_id, user_id FROM events WHERE event_type = 'purchase'")
def kind_filter(spark, d):
    return summaries.of_kind(_read(spark, d, "events").withColumnRenamed("event_type", "kind"), "purchase").select("event_id", "user_id")


@_query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_size FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE CASE WHEN (CASE WHEN p_type <> 'PROMO' THEN p_size % 8 END) IS NULL THEN TRUE WHEN p_type = 'ECONOMY' THEN l_linenumber >= p_size % 8 - 1 ELSE l_linenumber = p_size % 8 END""")
def arity_filter(spark, d):
    rows = _read(spark, d, "lineitem").join(_read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    params = F.when(F.col("p_type") != "PROMO", F.col("p_size") % 8)
    return rows.where(X.arity_fits(F.col("l_linenumber"), params, F.col("p_type") == "ECONOMY")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_size")


@_query("""SELECT s_suppkey, regexp_replace(s_name, '#.*', '') AS simple, CASE WHEN starts_with(s_name, 'Supplier#') THEN substr(s_name, 10) ELSE s_name END AS short FROM supplier""")
def name_projections(spark, d):
    simple = X.simple_name(F.concat(F.lit("a.b."), F.substring_index("s_name", "#", 1), F.lit("<T>")))
    short = X.short_name(F.replace(F.col("s_name"), F.lit("#"), F.lit(".")), F.lit("Supplier"))
    return _read(spark, d, "supplier").select("s_suppkey", simple.alias("simple"), short.alias("short"))


@_query("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 0 WHEN event_type IN ('signup', 'purchase') THEN 1 ELSE 2 END AS kind_rank FROM events")
def kind_rank(spark, d):
    kinds = F.create_map(*[F.lit(x) for p in (("view", "class"), ("click", "enum"), ("signup", "method"), ("purchase", "function"), ("error", "field")) for x in p])
    return _read(spark, d, "events").select("event_id", X.kind_rank(kinds[F.col("event_type")]).alias("kind_rank"))


@_query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN array_to_string(list_slice(string_split(host, '.'), 1, 2), '.') ELSE string_split(host, '.')[1] END AS name FROM (SELECT page_id, string_split(url, '/')[3] AS host FROM pages)")
def external_name(spark, d):
    host = F.get(F.split("url", "/"), F.lit(2))
    language = F.when(F.col("page_id") % 2 == 0, "java").otherwise("python")
    return _read(spark, d, "pages").select("page_id", X.external_name(host, language).alias("name"))


@_query("""SELECT doc_id, CASE WHEN length(t) > 60 THEN substr(t, 1, 59) || '…' ELSE t END AS clipped,
  length(text) - length(replace(text, chr(10), '')) + CASE WHEN length(text) > 0 AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END AS lines
FROM (SELECT doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)""")
def clip_and_lines(spark, d):
    return _read(spark, d, "documents").select("doc_id", X.clip(F.col("text"), 60).alias("clipped"), X.line_count(F.col("text")).cast("bigint").alias("lines"))


@_query("SELECT doc_id, sha1(encode('blob ' || CAST(octet_length(encode(text)) AS VARCHAR)) || '\\x00'::BLOB || encode(text)) AS blob FROM documents")
def blob_id(spark, d):
    return _read(spark, d, "documents").select("doc_id", X.git_blob_id(F.encode("text", "utf-8")).alias("blob"))


@_query("""SELECT doc_id, source || '.' || lang AS package, CASE WHEN source || lang IS NULL THEN NULL WHEN doc_id % 4 = 0 THEN './' WHEN doc_id % 4 = 1 THEN 'src/' WHEN doc_id % 4 = 2 THEN 'java/' END AS root FROM documents""")
def package_and_root(spark, d):
    k, home = F.col("doc_id") % 4, F.concat("source", F.lit("/"), "lang")
    path = F.when(k == 0, F.concat(home, F.lit("/m.py"))).when(k == 1, F.concat(F.lit("src/"), home, F.lit("/__init__.py"))).when(k == 2, F.concat(F.lit("java/"), home, F.lit("/A.java"))).otherwise(F.concat(F.lit("other/"), "lang", F.lit("/A.java")))
    module = F.concat("source", F.lit("."), "lang", F.when(k == 0, ".m").otherwise(""))
    files = _read(spark, d, "documents").select("doc_id", path.alias("path"), F.when(k < 2, "python").otherwise("java").alias("language"), module.alias("module"))
    files = files.withColumn("package", X.package_of(F.col("language"), F.col("path"), F.col("module")))
    return files.select("doc_id", "package", X.source_root(F.regexp_replace("path", "[^/]*$", ""), F.col("package")).alias("root"))


@_query("""SELECT CASE WHEN page_id % 2 = 0 THEN array_to_string(list_slice(string_split(host, '.'), 1, 2), '.') ELSE string_split(host, '.')[1] END AS name, count(*) AS n
FROM (SELECT page_id, string_split(url, '/')[3] AS host FROM pages WHERE NOT starts_with(url, 'https')) GROUP BY 1""")
def outside_imports(spark, d):
    host = F.get(F.split("url", "/"), F.lit(2))
    imports = _read(spark, d, "pages").select(F.when(F.col("page_id") % 2 == 0, "java").otherwise("python").alias("language"), host.alias("module"), F.when(F.startswith("url", F.lit("https")), host).alias("dst"))
    return summaries.outside_imports(imports)


# --- words and search --------------------------------------------------------------------

_WORDS = """lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '[^A-Za-z0-9]+', ' ', 'g'),
  '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g')))"""


@_query(f"SELECT s_suppkey AS id, {_WORDS.format('s_name')} AS words FROM supplier UNION ALL SELECT p_partkey + 1000000, {_WORDS.format('p_brand || p_type')} FROM part UNION ALL SELECT page_id + 2000000, regexp_replace({_WORDS.format('url')}, ' +', ' ', 'g') FROM pages")
def word_split(spark, d):
    one = lambda t, key, plus, name: _read(spark, d, t).select((F.col(key) + plus).alias("id"), X.split_words(name).alias("words"))
    return one("supplier", "s_suppkey", 0, F.col("s_name")).union(one("part", "p_partkey", 1_000_000, F.concat("p_brand", "p_type"))).union(one("pages", "page_id", 2_000_000, F.col("url")))


_TOKENS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


@_query(f"SELECT doc_id, len({_TOKENS}) AS n_tokens, len(list_distinct({_TOKENS})) AS n_terms FROM documents")
def token_counts(spark, d):
    t = X.tokens(F.col("text"))
    return _read(spark, d, "documents").select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(t)).cast("bigint").alias("n_terms"))


@_query(f"SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)) GROUP BY ALL")
def postings(spark, d):
    return search.postings(_read(spark, d, "documents"), ["doc_id"], "text")


@_query(f"""WITH tok AS (SELECT doc_id, {_TOKENS} AS t FROM documents), st AS (SELECT count(*) AS n_docs, avg(len(t)) AS avg_len FROM tok),
hit AS (SELECT doc_id, len(t) AS len, p, len(list_filter(t, lambda x: starts_with(x, p))) AS f FROM tok, (VALUES ('the'), ('an')) AS q(p)),
ok AS (SELECT * FROM hit WHERE f > 0), n AS (SELECT p, count(*) AS n FROM ok GROUP BY p),
sc AS (SELECT doc_id, count(*) AS k, sum(CASE WHEN ln((n_docs - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((n_docs - n + 0.5) / (n + 0.5)) END * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avg_len))) AS s FROM ok JOIN n USING (p), st GROUP BY doc_id)
SELECT doc_id, round(-s, 6) + 0.0 AS score FROM sc WHERE k = 2 ORDER BY round(-s, 6), doc_id LIMIT 200""")
def bm25_prefix_topk(spark, d):
    docs = _read(spark, d, "documents")
    sizes = docs.select("doc_id", F.size(X.tokens(F.col("text"))).cast("bigint").alias("len"))
    posts = search.postings(docs, ["doc_id"], "text")
    got = search.bm25_prefix(posts, sizes, ["doc_id"], ["the", "an"])
    return got.select("doc_id", (F.round("score", 6) + 0.0).alias("score")).orderBy("score", "doc_id").limit(200)


#: DuckDB counts edits in bytes: both sides compare names whose other characters are folded into one.
_PLAIN = r"[^\x00-\x7F]"
_CLOSE = f"""w AS (SELECT DISTINCT regexp_replace(unnest({_TOKENS}), '{_PLAIN}', '?', 'g') AS word FROM benchmark),
n AS (SELECT DISTINCT regexp_replace(unnest(string_split(string_split(url, '/')[3], '.')), '{_PLAIN}', '?', 'g') AS name FROM pages),
c AS (SELECT word, name, levenshtein(word, name) AS distance FROM w JOIN n ON levenshtein(word, name) <= 2)"""


def _words_and_hosts(spark, d):
    plain = lambda array, name: F.explode(F.transform(array, lambda x: F.regexp_replace(x, _PLAIN, "?"))).alias(name)
    words = _read(spark, d, "benchmark").select(plain(X.tokens(F.col("text")), "word"))
    return words, _read(spark, d, "pages").select(plain(F.split(F.get(F.split("url", "/"), F.lit(2)), r"\."), "name"))


@_query(f"WITH {_CLOSE} SELECT word, name, distance FROM c")
def close_names(spark, d):
    return search.close_names(*_words_and_hosts(spark, d)).withColumn("distance", F.col("distance").cast("bigint"))


@_query(f"WITH {_CLOSE} SELECT word, name, distance, row_number() OVER (PARTITION BY word ORDER BY distance, name) AS place FROM c QUALIFY place <= 3")
def closest_names(spark, d):
    return search.closest(*_words_and_hosts(spark, d), 3).withColumns({c: F.col(c).cast("bigint") for c in ("distance", "place")})


@_query("""SELECT doc_id, 0 AS tier FROM documents WHERE source = 'src3' UNION ALL
SELECT doc_id, 1 FROM documents WHERE source <> 'src3' AND list_has_any(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), ['that'])""")
def tiered_merge(spark, d):
    docs = _read(spark, d, "documents")
    exact = docs.where(F.col("source") == "src3").select("doc_id")
    words = docs.where(F.array_contains(X.tokens(F.col("text")), "that")).select("doc_id")
    return search.tiered_merge(exact, words, ["doc_id"])


# --- aggregates ----------------------------------------------------------------------------


@_query("SELECT (SELECT count(*) FROM documents) AS n_symbols, (SELECT count(*) FROM events) AS n_refs")
def totals(spark, d):
    return summaries.totals(_read(spark, d, "documents"), _read(spark, d, "events"))


@_query("SELECT lang, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (quality = 0) AS bad FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def language_counts(spark, d):
    rows = _read(spark, d, "documents").join(_read(spark, d, "labels"), "doc_id", "left")
    files = rows.select(_path().alias("path"), F.col("lang").alias("language"), F.col("n_chars").alias("line_count"), (F.col("quality") == 0).alias("has_errors"))
    return summaries.by_language(files).select(F.col("language").alias("lang"), "files", F.col("lines").alias("chars"), F.col("errors").alias("bad"))


@_query("SELECT source AS package, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars, array_to_string(list_sort(list(DISTINCT lang)), ',') AS dirs FROM documents GROUP BY source ORDER BY chars DESC, package")
def package_rollup(spark, d):
    files = _read(spark, d, "documents").select(F.col("source").alias("package"), F.col("n_chars").alias("line_count"), "lang")
    return summaries.by_package(files, F.col("lang")).select("package", "files", F.col("lines").alias("chars"), F.array_join("roots", ",").alias("dirs"))


@_query("SELECT event_type AS kind, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(event_id)) AS place FROM events GROUP BY event_type")
def kind_histogram(spark, d):
    rows = summaries.by_kind(_read(spark, d, "events").withColumnRenamed("event_type", "kind"), F.col("event_id"))
    return rows.select("kind", "n", F.row_number().over(Window.orderBy(F.desc("n"), "first")).cast("bigint").alias("place"))  # a row a kind


@_query("""SELECT count(*) FILTER (value >= 20) AS exact, count(*) FILTER (value >= 5 AND value < 20) AS likely, count(*) FILTER (value < 5) AS possible,
  count(DISTINCT user_id) AS files, round(count(*) FILTER (user_id % 7 = 0) / count(*), 6) AS test_share FROM events""")
def tier_histogram(spark, d):
    tier = F.when(F.col("value") >= 20, 3).when(F.col("value") >= 5, 2).when(F.col("value") < 5, 1)
    n = summaries.by_tier(_read(spark, d, "events").select(F.col("user_id").alias("path"), tier.alias("tier")), F.col("path") % 7 == 0)
    return n.select("exact", "likely", "possible", "files", F.round(F.col("tests") / F.col("n"), 6).alias("test_share"))


@_query("""WITH r AS (SELECT *, row_number() OVER (ORDER BY value DESC, event_id) AS p FROM events)
SELECT user_id, count(*) AS n FROM r WHERE p > 10 GROUP BY user_id ORDER BY n DESC, user_id LIMIT 3""")
def files_beyond_limit(spark, d):
    rows = _read(spark, d, "events").withColumnRenamed("user_id", "path")
    return summaries.files_beyond(rows, ["event_id"], [F.desc("value"), "event_id"], 10, 3).withColumnRenamed("path", "user_id")


@_query("""WITH r AS (SELECT *, row_number() OVER (ORDER BY value DESC, event_id) AS p FROM events)
SELECT user_id, count(*) AS n, min(p) AS first_place FROM r WHERE p > 100 GROUP BY user_id ORDER BY n DESC, first_place LIMIT 3""")
def dropped_topfiles(spark, d):
    rows = _read(spark, d, "events")
    cut = rows.orderBy(F.desc("value"), "event_id").limit(100).select("event_id")
    rest = rows.join(cut, "event_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("n"), F.max(F.struct("value", -F.col("event_id"))).alias("m"))
    # the place of a user's first row: 1 + rows that rank before it, by one range count over the few users kept
    top = rest.orderBy(F.desc("n"), F.desc("m")).limit(3)
    before = top.join(rows.select(F.struct("value", -F.col("event_id")).alias("x")), F.col("x") >= F.col("m")).groupBy("user_id", "n").agg(F.count("*").alias("first_place"))
    return before.orderBy(F.desc("n"), "first_place")


# --- module graph ------------------------------------------------------------------------------

_TRADE = """trade AS (SELECT c.c_nationkey AS src, s.s_nationkey AS dst, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag = 'R' AS deferred
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey)"""
_EDGES = f"WITH RECURSIVE {_TRADE}, edges AS (SELECT src, dst, count(*) AS n FROM trade WHERE src <> dst GROUP BY ALL)"
_LINKS = """WITH RECURSIVE links AS (SELECT DISTINCT src, dst FROM (SELECT c_nationkey AS src, (c_nationkey * c_nationkey + 3) % 25 AS dst FROM customer
  UNION ALL SELECT s_nationkey, (s_nationkey * 3 + 1) % 25 FROM supplier) WHERE src <> dst)"""


def _trade(spark, d):
    lines, orders = _read(spark, d, "lineitem"), _read(spark, d, "orders").select("o_orderkey", "o_custkey")
    customers = _read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    suppliers = _read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select("src", "dst", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").alias("deferred"))


def _links(spark, d):
    one = _read(spark, d, "customer").selectExpr("c_nationkey as src", "(c_nationkey * c_nationkey + 3) % 25 as dst")
    return one.union(_read(spark, d, "supplier").selectExpr("s_nationkey", "(s_nationkey * 3 + 1) % 25")).where("src <> dst").distinct()


@_query(f"{_EDGES} SELECT src, dst, n FROM edges")
def edge_weights(spark, d):
    return graph.edge_weights(_trade(spark, d))


@_query(f"{_EDGES} SELECT dst, count(DISTINCT src) AS n_importers FROM edges WHERE n > 90 GROUP BY dst ORDER BY n_importers DESC, dst LIMIT 5")
def most_imported(spark, d):
    return graph.importers(graph.edge_weights(_trade(spark, d)).where("n > 90"), 5)


@_query(f"""WITH {_TRADE} SELECT src, dst, arg_min(CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR),
  (CAST(deferred AS INT), l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS example FROM trade WHERE src <> dst GROUP BY ALL""")
def edge_example(spark, d):
    rows = _trade(spark, d).withColumn("where", F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    return graph.edge_examples(rows, ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "where", "deferred")


@_query("""SELECT s_suppkey, coalesce(a.r_name, b.r_name) AS target, a.r_name IS NULL AND b.r_name IS NULL AS external FROM supplier JOIN nation ON s_nationkey = n_nationkey
LEFT JOIN region a ON a.r_regionkey = n_nationkey AND a.r_name < 'ASIA' LEFT JOIN region b ON b.r_regionkey = n_regionkey AND b.r_name > 'ASIA'""")
def external_split(spark, d):
    regions = _read(spark, d, "region")
    a = regions.where("r_name < 'ASIA'").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("a"))
    b = regions.where("r_name > 'ASIA'").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("b"))
    rows = _read(spark, d, "supplier").join(_read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.join(a, "n_nationkey", "left").join(b, "n_regionkey", "left")
    return rows.select("s_suppkey", F.coalesce("a", "b").alias("target"), (F.col("a").isNull() & F.col("b").isNull()).alias("external"))


@_query(f"""{_EDGES}, g AS (SELECT a.n_regionkey AS ga, b.n_regionkey AS gb, n FROM edges JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey WHERE a.n_regionkey <> b.n_regionkey)
SELECT "group", CAST(sum(o) AS BIGINT) AS out_edges, CAST(sum(i) AS BIGINT) AS in_edges FROM (SELECT ga AS "group", n AS o, 0 AS i FROM g UNION ALL SELECT gb, 0, n FROM g) GROUP BY ALL""")
def group_in_out(spark, d):
    members = _read(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("group"))
    return graph.group_degrees(graph.edge_weights(_trade(spark, d)), members)


@_query(f"""{_LINKS}, reach(a, b) AS (SELECT src, dst FROM links UNION SELECT a, dst FROM reach JOIN links ON b = src),
same AS (SELECT x.a AS node, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM same QUALIFY count(*) OVER (PARTITION BY component) > 1""")
def strong_components(spark, d):
    shared_folder(spark)
    return graph.strong_components(_links(spark, d))


@_query(f"""{_LINKS}, reach(a, b) AS (SELECT src, dst FROM links UNION SELECT a, dst FROM reach JOIN links ON b = src),
same AS (SELECT x.a AS node, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
comp AS (SELECT * FROM same QUALIFY count(*) OVER (PARTITION BY component) > 1),
walk(component, node, path) AS (SELECT DISTINCT component, component, [component] FROM comp
  UNION ALL SELECT w.component, h.dst, list_append(w.path, h.dst) FROM walk w JOIN links h ON w.node = h.src JOIN comp c ON c.node = h.dst AND c.component = w.component
  WHERE NOT list_contains(list_slice(w.path, 2, len(w.path)), h.dst) AND (len(w.path) = 1 OR w.node <> w.component) AND len(w.path) <= 26)
SELECT component, array_to_string(arg_min(path, (len(path), path)), ' -> ') AS loop FROM walk WHERE len(path) > 1 AND node = component GROUP BY component""")
def shortest_loop(spark, d):
    shared_folder(spark)
    edges = _links(spark, d).checkpoint()
    loops = graph.shortest_loops(edges, graph.strong_components(edges))
    return loops.select("component", F.array_join(F.transform("loop", lambda x: x.cast("string")), " -> ").alias("loop"))


# --- hierarchy and intervals ---------------------------------------------------------------------

_TREE = """tree AS (SELECT 'r' || r_regionkey AS node, CAST(NULL AS VARCHAR) AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"""
_CLOSURE = f"WITH RECURSIVE {_TREE}, up(node, ancestor, depth) AS (SELECT node, parent, 1 FROM tree WHERE parent IS NOT NULL UNION ALL SELECT up.node, t.parent, depth + 1 FROM up JOIN tree t ON up.ancestor = t.node WHERE t.parent IS NOT NULL)"


def _tree(spark, d):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    one = lambda t, p, c, q, e: _read(spark, d, t).select(name(p, c).alias("node"), name(q, e).alias("parent"))
    top = _read(spark, d, "region").select(name("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
    tree = top.union(one("nation", "n", "n_nationkey", "r", "n_regionkey")).union(one("supplier", "s", "s_suppkey", "n", "s_nationkey")).union(one("customer", "c", "c_custkey", "n", "c_nationkey"))
    return tree.withColumn("tree", F.lit(0))


def _closure(spark, d):
    shared_folder(spark)
    return hierarchy.ancestors(_tree(spark, d), ["tree"], "parent", "node").select("node", "ancestor", "depth")


@_query(f"{_CLOSURE} SELECT node, ancestor, CAST(depth AS BIGINT) AS depth FROM up")
def ancestor_closure(spark, d):
    return _closure(spark, d)


@_query(f"{_CLOSURE} SELECT node, CAST(coalesce(max(depth), 0) AS BIGINT) AS depth FROM tree LEFT JOIN up USING (node) GROUP BY node")
def nesting_depth(spark, d):
    rows = _tree(spark, d).select("node").join(_closure(spark, d), "node", "left")
    return rows.groupBy("node").agg(F.coalesce(F.max("depth"), F.lit(0)).alias("depth"))


@_query(f"{_CLOSURE}, calls AS (SELECT node FROM tree WHERE node[1] IN ('n', 's')) SELECT node FROM calls WHERE node NOT IN (SELECT up.node FROM up JOIN calls ON up.ancestor = calls.node)")
def outermost(spark, d):
    kind = F.when(F.substring("node", 1, 1) == "n", "function").when(F.substring("node", 1, 1) == "s", "method").otherwise("class")
    symbols = _tree(spark, d).select(F.lit("t").alias("path"), F.col("node").alias("ordinal"), kind.alias("kind"))
    closure = _closure(spark, d).withColumn("path", F.lit("t"))
    return hierarchy.outermost_callables(symbols, closure).select(F.col("ordinal").alias("node"))


_SPANS = "spans AS (SELECT o_custkey % 150 AS k, o_orderkey, CAST(o_totalprice AS BIGINT) % 1000 AS a, CAST(o_totalprice AS BIGINT) % 1000 + o_orderkey % 200 AS b FROM orders), pts AS (SELECT event_id, user_id AS k, event_id % 1200 AS line FROM events)"


def _spans(spark, d):
    price = F.round("o_totalprice").cast("bigint") % 1000
    spans = _read(spark, d, "orders").select((F.col("o_custkey") % 150).alias("k"), "o_orderkey", price.alias("a"), (price + F.col("o_orderkey") % 200).alias("b"))
    points = _read(spark, d, "events").select("event_id", F.col("user_id").alias("k"), (F.col("event_id") % 1200).alias("line"))
    return points, spans


_SPANS = _SPANS.replace("CAST(o_totalprice AS BIGINT)", "CAST(floor(o_totalprice + 0.5) AS BIGINT)")


@_query(f"WITH {_SPANS} SELECT event_id, count(*) AS n FROM pts JOIN spans USING (k) WHERE line BETWEEN a AND b GROUP BY event_id")
def interval_containment(spark, d):
    points, spans = _spans(spark, d)
    return hierarchy.holding(points, spans, ["k"], "line", "a", "b").groupBy("event_id").agg(F.count("*").alias("n"))


@_query(f"WITH {_SPANS} SELECT event_id, p.k AS k, line, arg_max(o_orderkey, (a, a - b, -o_orderkey)) FILTER (line BETWEEN a AND b) AS o_orderkey FROM pts p LEFT JOIN spans s ON p.k = s.k GROUP BY ALL")
def innermost_interval(spark, d):
    points, spans = _spans(spark, d)
    return hierarchy.innermost(points, spans, ["k"], "line", "a", "b", [F.col("a") - F.col("b"), -F.col("o_orderkey")], "o_orderkey")


@_query(f"WITH {_SPANS} SELECT event_id, k, line, EXISTS (SELECT 1 FROM spans s WHERE s.k = p.k AND a < line AND line <= b) AS inside FROM pts p")
def deferred_flag(spark, d):
    points, spans = _spans(spark, d)
    return hierarchy.inside_any(points, spans, ["k"], "line", "a", "b")


# --- resolution core -----------------------------------------------------------------------------

_CAND = """cand AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_partkey, CASE WHEN p_partkey = l_partkey AND l_linenumber % 2 = 1 THEN 3 WHEN p_size = l_linenumber THEN NULL
  WHEN p_brand = 'Brand#' || CAST(l_suppkey % 25 + 1 AS VARCHAR) THEN 2 WHEN p_size > 48 THEN 1 END AS tier
  FROM lineitem JOIN part ON p_partkey // 8 = l_partkey // 8 AND (p_partkey = l_partkey OR l_linenumber > 3)),
best AS (SELECT * FROM cand WHERE tier IS NOT NULL QUALIFY tier = max(tier) OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey))"""
_REF = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _best(spark, d, of: int | None = None):
    """The best candidates of each line; with a part, only of lines that may name it: a name is shared by eight parts."""
    lines = _read(spark, d, "lineitem").select(*_REF).withColumn("name", F.expr("l_partkey div 8"))
    parts = _read(spark, d, "part").select("p_partkey", "p_size", "p_brand").withColumn("name", F.expr("p_partkey div 8"))
    lines = lines if of is None else lines.where(F.col("name") == of // 8)
    rows = lines.join(parts, "name").where("p_partkey = l_partkey or l_linenumber > 3")
    same_brand = F.col("p_brand") == F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 25 + 1).cast("string"))
    tier = F.when((F.col("p_partkey") == F.col("l_partkey")) & (F.col("l_linenumber") % 2 == 1), 3).when(F.col("p_size") == F.col("l_linenumber"), None).when(same_brand, 2).when(F.col("p_size") > 48, 1)
    return ranking.best_tier(rows.withColumn("tier", tier), _REF).select(*_REF, "p_partkey", "tier")


@_query(f"WITH {_CAND} SELECT * FROM best")
def best_tier_resolution(spark, d):
    return _best(spark, d)


@_query(f"WITH {_CAND} SELECT * FROM best WHERE p_partkey = 17")
def inverse_references(spark, d):
    return _best(spark, d, 17).where("p_partkey = 17")


@_query("SELECT a.s_suppkey AS owner, b.s_suppkey AS derived FROM supplier a JOIN supplier b ON a.s_suppkey = b.s_suppkey // 2")
def base_name_hop(spark, d):
    suppliers = _read(spark, d, "supplier")
    owners = suppliers.select(F.col("s_suppkey").alias("owner"), F.expr("concat('Shop', s_suppkey)").alias("base"))
    derived = suppliers.select(F.col("s_suppkey").alias("derived"), X.simple_name(F.expr("concat('sold.by.Shop', s_suppkey div 2, '<T>')")).alias("base"))
    return owners.join(derived, "base").select("owner", "derived")


@_query("""SELECT c_custkey, arg_min(qn, prio) AS qn, min(prio) AS prio FROM (
  SELECT c_custkey, 'exact.' || s_suppkey AS qn, 1 AS prio FROM customer JOIN supplier ON s_suppkey = c_custkey
  UNION ALL SELECT c_custkey, 'nation.' || n_name, 2 FROM customer JOIN nation ON n_nationkey = c_custkey % 40
  UNION ALL SELECT c_custkey, 'region.' || r_name, 3 FROM customer JOIN region ON r_regionkey = c_nationkey % 9) GROUP BY c_custkey""")
def type_lookup_cascade(spark, d):
    c = _read(spark, d, "customer")
    one = lambda t, on, qn, prio: c.join(_read(spark, d, t), on).select("c_custkey", F.concat_ws(".", *qn).alias("qn"), F.lit(prio).alias("prio"))
    rows = one("supplier", F.col("s_suppkey") == F.col("c_custkey"), [F.lit("exact"), F.col("s_suppkey").cast("string")], 1)
    rows = rows.union(one("nation", F.col("n_nationkey") == F.col("c_custkey") % 40, [F.lit("nation"), "n_name"], 2))
    rows = rows.union(one("region", F.col("r_regionkey") == F.col("c_nationkey") % 9, [F.lit("region"), "r_name"], 3))
    return rows.groupBy("c_custkey").agg(F.min_by("qn", "prio").alias("qn"), F.min("prio").alias("prio"))


# --- versions, impact and history ------------------------------------------------------------------


@_query("""WITH a AS (SELECT o_orderkey AS k, o_orderpriority AS v FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE o_orderpriority END AS v FROM orders WHERE o_orderkey % 5 <> 0)
SELECT coalesce(a.k, b.k) AS path, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v""")
def snapshot_diff(spark, d):
    rows = _read(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderpriority").alias("blob"))
    head = rows.where("path % 5 <> 0").withColumn("blob", F.when(F.col("path") % 11 == 0, "x").otherwise(F.col("blob")))
    return versions.snapshot_diff(rows.where("path % 7 <> 0"), head, "path", "blob").select("path", "status")


_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_PAIRS = f"""v AS (SELECT l_partkey AS qn, l_returnflag AS decl, l_linestatus AS body, month(l_shipdate) % 2 AS side, {_KEYS}, l_partkey * 0 AS z FROM lineitem),
n1 AS (SELECT *, row_number() OVER (PARTITION BY qn, decl, side ORDER BY {_KEYS}) AS k FROM v),
p1 AS (SELECT o.qn AS qn, o.l_orderkey AS old_key, o.l_linenumber AS old_line, o.decl AS od, o.body AS ob, w.l_orderkey AS new_key, w.l_linenumber AS new_line, w.decl AS nd, w.body AS nb
  FROM (SELECT * FROM n1 WHERE side = 0) o JOIN (SELECT * FROM n1 WHERE side = 1) w ON o.qn = w.qn AND o.decl = w.decl AND o.k = w.k),
lo AS (SELECT *, row_number() OVER (PARTITION BY qn ORDER BY {_KEYS}) AS j FROM n1 o WHERE side = 0 AND NOT EXISTS (SELECT 1 FROM n1 w WHERE w.side = 1 AND w.qn = o.qn AND w.decl = o.decl AND w.k = o.k)),
ln AS (SELECT *, row_number() OVER (PARTITION BY qn ORDER BY {_KEYS}) AS j FROM n1 w WHERE side = 1 AND NOT EXISTS (SELECT 1 FROM n1 o WHERE o.side = 0 AND w.qn = o.qn AND w.decl = o.decl AND w.k = o.k)),
p2 AS (SELECT coalesce(lo.qn, ln.qn) AS qn, lo.l_orderkey AS old_key, lo.l_linenumber AS old_line, lo.decl AS od, lo.body AS ob, ln.l_orderkey AS new_key, ln.l_linenumber AS new_line, ln.decl AS nd, ln.body AS nb FROM lo FULL JOIN ln ON lo.qn = ln.qn AND lo.j = ln.j),
pairs AS (SELECT *, CASE WHEN new_key IS NULL THEN 'removed' WHEN old_key IS NULL THEN 'added' WHEN od <> nd THEN 'signature' WHEN ob <> nb THEN 'body' END AS change FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2))"""


def _pairs(spark, d):
    rows = _read(spark, d, "lineitem").select(F.col("l_partkey").alias("qn"), F.col("l_returnflag").alias("decl"), F.col("l_linestatus").alias("body"), (F.month("l_shipdate") % 2).alias("side"), *_REF)
    paired = versions.pair_versions(rows.where("side = 0"), rows.where("side = 1"), ["qn"], ["decl"], _REF)
    return paired.withColumn("change", versions.change_kind(["decl"], "body"))


@_query(f"WITH {_PAIRS} SELECT qn, old_key, old_line, new_key, new_line, change FROM pairs")
def version_pairing(spark, d):
    return _pairs(spark, d).select(
        F.coalesce("old.qn", "new.qn").alias("qn"), F.col("old.l_orderkey").alias("old_key"), F.col("old.l_linenumber").alias("old_line"),
        F.col("new.l_orderkey").alias("new_key"), F.col("new.l_linenumber").alias("new_line"), "change",
    )


@_query(f"WITH {_PAIRS} SELECT change, count(*) AS n FROM pairs WHERE change IS NOT NULL GROUP BY change")
def change_histogram(spark, d):
    return _pairs(spark, d).where("change is not null").groupBy("change").agg(F.count("*").alias("n"))


@_query("""SELECT doc_id, regexp_replace(coalesce(array_to_string(list_slice(l, 1, 1) || list_slice(l, 4, len(l)), ''), ''), '\\s+', '', 'g') AS own FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def own_text(spark, d):
    docs = _read(spark, d, "documents")
    n = F.size(F.split("text", "\n"))
    path = F.col("doc_id").cast("string").alias("path")
    none = F.lit(None).cast("int")
    whole = docs.select(path, F.lit(0).alias("ordinal"), none.alias("parent_ordinal"), F.lit("method").alias("kind"), F.lit(1).alias("start_line"), n.alias("end_line"))
    inner = docs.select(path, F.lit(1).alias("ordinal"), F.lit(0).alias("parent_ordinal"), F.lit("method").alias("kind"), F.lit(2).alias("start_line"), F.lit(3).alias("end_line"))
    lines = docs.select(path, F.posexplode(F.split("text", "\n")).alias("p", "text")).select("path", (F.col("p") + 1).alias("line"), "text")
    own = versions.own_texts(whole.union(inner), lines).where("ordinal = 0")
    return own.select(F.col("path").cast("bigint").alias("doc_id"), "own")


@_query("SELECT DISTINCT o_orderkey FROM (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0 UNION ALL SELECT o_orderkey FROM orders JOIN customer ON o_orderkey = c_custkey WHERE c_acctbal < 0 AND o_orderstatus = 'F')")
def dangling_imports(spark, d):
    gone = _read(spark, d, "customer").where("c_acctbal < 0").select(F.lit("python").alias("language"), F.concat(F.lit("k."), F.col("c_custkey").cast("string")).alias("qualified_name"))
    orders = _read(spark, d, "orders").withColumns({"path": F.col("o_orderkey"), "language": F.lit("python"), "line": F.lit(1)})
    name = F.col("o_custkey").cast("string")
    by_name = orders.withColumns({"ordinal": F.lit(0), "module": F.lit("k"), "name": name, "is_static": F.lit(False)})
    static = orders.where("o_orderstatus = 'F'").withColumns({"ordinal": F.lit(1), "module": F.concat(F.lit("k."), F.col("o_orderkey").cast("string")), "name": F.lit(None).cast("string"), "is_static": F.lit(True)})
    return summaries.naming_imports(gone, by_name.unionByName(static)).select(F.col("i_path").alias("o_orderkey")).distinct()


@_query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) AND user_id IN (SELECT s_suppkey FROM supplier)")
def outside_semi_anti(spark, d):
    changed = _read(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("path"))
    touched = _read(spark, d, "supplier").select(F.col("s_suppkey").alias("dst"))
    imports = _read(spark, d, "events").withColumns({"path": F.col("user_id"), "dst": F.col("user_id")})
    return summaries.importers_outside(imports, touched, changed).select("event_id", "user_id")


@_query("""SELECT user_id, event_type, count(*) FILTER (value >= 5 AND (NOT inside OR event_type = 'error')) AS strong, count(*) FILTER (value < 5) AS weak
FROM (SELECT *, user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) AS inside FROM events) GROUP BY user_id, event_type""")
def callers_that_notice(spark, d):
    changed = _read(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("inside"))
    hits = _read(spark, d, "events").join(changed, "user_id", "left").fillna({"inside": False})
    tier = F.when(F.col("value") >= 20, 3).when(F.col("value") >= 5, 2).otherwise(1)
    return summaries.notice(hits.withColumns({"tier": tier, "change": F.when(F.col("event_type") == "error", "removed").otherwise("body")}), ["user_id", "event_type"])


@_query("""WITH c AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'removed' WHEN 'O' THEN 'signature' ELSE 'body' END AS change, o_orderpriority FROM orders)
SELECT o_orderkey, change, row_number() OVER (ORDER BY CASE change WHEN 'removed' THEN 0 WHEN 'signature' THEN 1 ELSE 2 END, o_orderkey) <= 200 AS looked_up FROM c WHERE o_orderpriority NOT LIKE '1%'""")
def lookup_budget(spark, d):
    change = F.when(F.col("o_orderstatus") == "F", "removed").when(F.col("o_orderstatus") == "O", "signature").otherwise("body")
    kind = F.when(F.startswith("o_orderpriority", F.lit("1")), "field").otherwise("method")
    first, beyond = summaries.within_lookups(_read(spark, d, "orders").select("o_orderkey", change.alias("change"), kind.alias("kind")), ["o_orderkey"], 200)
    flag = lambda rows, x: rows.select("o_orderkey", "change", F.lit(x).alias("looked_up"))
    return flag(first, True).union(flag(beyond, False))


@_query(f"""WITH {_PAIRS}, c AS (SELECT qn, min(change) AS change, count(*) AS weak, count(*) FILTER (ob = 'O') AS strong FROM pairs WHERE change IS NOT NULL GROUP BY qn)
SELECT qn, change, CASE WHEN change = 'added' THEN 4 WHEN change IN ('removed', 'signature') THEN CASE WHEN strong > 0 THEN 0 ELSE 2 END ELSE CASE WHEN strong > 0 THEN 1 ELSE 3 END END AS "group", strong, weak FROM c""")
def impact_rank_groups(spark, d):
    rows = _pairs(spark, d).where("change is not null").groupBy(F.coalesce("old.qn", "new.qn").alias("qn"))
    rows = rows.agg(F.min("change").alias("change"), F.count("*").alias("weak"), F.count_if(F.col("old.body") == "O").alias("strong"))
    return rows.select("qn", "change", ranking.impact_group(F.col("change"), F.col("strong")).alias("group"), "strong", "weak")


@_query("SELECT event_id, max(tier) AS tier FROM (SELECT event_id, 2 AS tier FROM events WHERE value > 10 UNION ALL SELECT event_id, CASE WHEN event_type = 'click' THEN 3 ELSE 1 END FROM events WHERE value < 20) GROUP BY event_id")
def best_of_union(spark, d):
    e = _read(spark, d, "events")
    a = e.where("value > 10").select("event_id", F.lit(2).alias("tier"))
    b = e.where("value < 20").select("event_id", F.when(F.col("event_type") == "click", 3).otherwise(1).alias("tier"))
    return summaries.best_of_each(a.unionByName(b), ["event_id"])


@_query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS repeat FROM events")
def first_vs_repeat(spark, d):
    return ranking.repeats(_read(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "repeat")


@_query(f"SELECT {_KEYS}, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, {_KEYS} LIMIT 50")
def topk(spark, d):
    return _read(spark, d, "lineitem").select(*_REF, "l_extendedprice").orderBy(F.desc("l_extendedprice"), *_REF).limit(50)


@_query("SELECT o_custkey, o_orderkey, o_totalprice, place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3")
def topk_per_group(spark, d):
    return ranking.top_per_group(_read(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "o_totalprice", F.col("place").cast("bigint").alias("place"))


@_query("SELECT g AS \"group\", page_id, used FROM (SELECT page_id % 3 AS g, page_id, CAST(sum(length(url) + 1) OVER (PARTITION BY page_id % 3 ORDER BY length(html) DESC, page_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM pages) WHERE used <= 2000 * 3 - 560 - 100")
def budgeted_prefix_flat(spark, d):
    pages = _read(spark, d, "pages").select((F.col("page_id") % 3).alias("group"), "page_id", F.length("html").alias("n"), "url")
    return ranking.prefix_within(pages, "url", [F.desc("n"), "page_id"], ranking.budget(2000, 100), ["group"]).select("group", "page_id", "used")


_BILL = "CAST(l_orderkey AS VARCHAR) || l_returnflag || l_linestatus"


@_query(f"SELECT {_KEYS}, used FROM (SELECT {_KEYS}, CAST(sum(length({_BILL}) + 1) OVER (ORDER BY l_extendedprice DESC, {_KEYS} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM lineitem) WHERE used <= 50000")
def budgeted_prefix_whole(spark, d):
    lines = _read(spark, d, "lineitem").select(*_REF, "l_extendedprice", F.concat(F.col("l_orderkey").cast("string"), "l_returnflag", "l_linestatus").alias("text"))
    return ranking.prefix_within(lines, "text", [F.desc("l_extendedprice"), *_REF], 50_000).select(*_REF, "used")


@_query("""SELECT g AS "group", page_id, used FROM (SELECT g, page_id, CAST(sum(length(url) + 3 + CASE WHEN first THEN length(host) + 1 - 8 ELSE 0 END) OVER (PARTITION BY g ORDER BY n DESC, page_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used
FROM (SELECT *, row_number() OVER (PARTITION BY g, host ORDER BY n DESC, page_id) = 1 AS first FROM (SELECT page_id % 3 AS g, page_id, url, length(html) AS n, list_extract(string_split(url, '/'), 1) || '//' || list_extract(string_split(url, '/'), 3) AS host FROM pages))) WHERE used <= 1500 * 3 - 560""")
def budgeted_prefix_grouped(spark, d):
    pages = _read(spark, d, "pages").select((F.col("page_id") % 3).alias("group"), "page_id", F.length("html").alias("n"), "url", F.concat_ws("//", F.get(F.split("url", "/"), F.lit(0)), F.get(F.split("url", "/"), F.lit(2))).alias("host"))
    return ranking.grouped_prefix_within(pages, "url", "host", [F.desc("n"), "page_id"], ranking.budget(1500), ["group"], under=8).select("group", "page_id", "used")


@_query("SELECT source, CASE WHEN count(DISTINCT doc_id) < 2 THEN '' WHEN count(DISTINCT lang) = 1 THEN 'corpus/' || source || '/' || min(lang) ELSE 'corpus/' || source END AS common_dir FROM documents GROUP BY source")
def common_prefix(spark, d):
    docs = _read(spark, d, "documents").select("source", F.concat(F.lit("corpus/"), _path()).alias("path"))
    return ranking.common_directory(docs, ["source"], "path")


@_query("""SELECT a.user_id AS path, churn, size, churn * size AS score FROM (SELECT user_id, count(DISTINCT event_id) AS churn FROM events GROUP BY user_id) a
JOIN (SELECT o_custkey AS user_id, count(*) AS size FROM orders GROUP BY o_custkey) b ON a.user_id = b.user_id ORDER BY score DESC, churn DESC, path LIMIT 10""")
def churn_size_score(spark, d):
    changes = _read(spark, d, "events").groupBy(F.col("user_id").alias("path")).agg(F.countDistinct("event_id").alias("churn"))
    sizes = _read(spark, d, "orders").groupBy(F.col("o_custkey").alias("path")).agg(F.count("*").alias("size"))
    return history.hotspots(changes, sizes, ["path"]).limit(10)


@_query("""WITH a AS (SELECT doc_id AS path, lang AS module, md5(text) AS hash, n_chars AS size, doc_id * 1000 AS mtime_ns FROM documents WHERE doc_id % 9 <> 0),
b AS (SELECT doc_id AS path, CASE WHEN doc_id % 31 = 0 THEN 'moved' ELSE lang END AS module, CASE WHEN doc_id % 13 = 0 THEN md5(text || 'x') ELSE md5(text) END AS hash, n_chars + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS size, doc_id * 1000 + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS mtime_ns FROM documents WHERE doc_id % 8 <> 0)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'remove' WHEN a.path IS NULL THEN 'parse' WHEN a.module = b.module AND b.mtime_ns < 900000 AND a.size = b.size AND a.mtime_ns = b.mtime_ns THEN 'unchanged' WHEN a.module = b.module AND a.hash = b.hash THEN 'stat' ELSE 'parse' END AS action FROM a FULL JOIN b ON a.path = b.path""")
def refresh_cascade(spark, d):
    docs = _read(spark, d, "documents")
    i = F.col("doc_id")
    known = docs.where("doc_id % 9 <> 0").select(i.alias("path"), F.col("lang").alias("module"), F.md5("text").alias("hash"), F.col("n_chars").alias("size"), (i * 1000).alias("mtime_ns"))
    edited = i % 13 == 0
    found = docs.where("doc_id % 8 <> 0").select(
        i.alias("path"), F.when(i % 31 == 0, "moved").otherwise(F.col("lang")).alias("module"), F.md5(F.when(edited, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("hash"),
        (F.col("n_chars") + edited.cast("int")).alias("size"), (i * 1000 + (i % 4 == 0).cast("int")).alias("mtime_ns"),
    )
    return history.refresh_cascade(known, found, last_run_ns=900_000 + 2_000_000_000)


@_query("""WITH RECURSIVE e AS (SELECT user_id % 10 AS repo, -event_id AS pos, CAST(floor(epoch(ts)) AS BIGINT) AS time, event_type, CAST(user_id % 50 AS VARCHAR) AS path, CAST((user_id + 7) % 50 AS VARCHAR) AS old FROM events),
life AS (SELECT repo, old AS name, pos, path AS via FROM e WHERE event_type = 'error' UNION ALL SELECT repo, path, pos, NULL FROM e WHERE event_type IN ('error', 'signup')),
span AS (SELECT *, lead(pos) OVER (PARTITION BY repo, name ORDER BY pos) AS until FROM life),
link AS (SELECT s.repo, s.name, s.pos, s.via, p.pos AS p_pos FROM span s LEFT JOIN span p ON p.repo = s.repo AND p.name = s.via AND p.pos < s.pos AND (p.until IS NULL OR s.pos <= p.until)),
walk(repo, name, pos, via, p_pos) AS (SELECT * FROM link UNION ALL SELECT w.repo, w.name, w.pos, l.via, l.p_pos FROM walk w JOIN link l ON w.p_pos IS NOT NULL AND l.repo = w.repo AND l.name = w.via AND l.pos = w.p_pos),
today AS (SELECT repo, name, pos, via FROM walk WHERE p_pos IS NULL),
named AS (SELECT e.repo, e.pos, e.time, CASE WHEN s.pos IS NULL THEN e.path ELSE t.via END AS path FROM e LEFT JOIN span s ON s.repo = e.repo AND s.name = e.path AND s.pos < e.pos AND (s.until IS NULL OR e.pos <= s.until)
  LEFT JOIN today t ON t.repo = s.repo AND t.name = s.name AND t.pos = s.pos)
SELECT CAST(repo AS VARCHAR) AS repo, path, count(*) AS churn, arg_min(time, pos) AS last FROM named WHERE path IS NOT NULL GROUP BY repo, path""")
def rename_churn_fold(spark, d):
    kinds = F.when(F.col("event_type") == "signup", "A").when(F.col("event_type") == "error", "R").otherwise("M")
    rows = _read(spark, d, "events").select(
        (F.col("user_id") % 10).cast("string").alias("repo"), (-F.col("event_id")).alias("pos"), F.unix_timestamp("ts").alias("time"), kinds.alias("status"),
        (F.col("user_id") % 50).cast("string").alias("path"), F.when(kinds == "R", ((F.col("user_id") + 7) % 50).cast("string")).alias("old_path"),
    )
    return history.churn(rows)
