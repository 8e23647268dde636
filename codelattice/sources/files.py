"""Source files: discovery, extraction, and a versioned index of Parquet tables."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from stat import S_ISREG

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.lineage import cut
from ..functions.shipping import ship
from ..functions.text import directories, line_count, tokens
from ..operators import search
from ..operators.history import refresh_cascade
from ..streaming.freshness import Published
from .git import git
from .java_code import extract_java
from .model import FILES, IMPORTS, REFS, SCHEMA_VERSION, SYMBOLS, TABLES, columns_of
from .python_code import extract_python

#: Folders that hold no source of the repository itself.
SKIP_DIRS = (
    ".git", ".hg", ".svn", ".tox", ".nox", ".venv", "venv", ".eggs", ".mypy_cache", ".pytest_cache", ".gradle", "__pycache__", "node_modules", "site-packages", "third_party", "vendor", "build",
    "dist", "target",
)
MAX_FILE_BYTES = 1_000_000
BINARY_PROBE = 8192
#: Files changed so shortly before a run may change again with the same time.
RACY_NS = 2_000_000_000


def language(path):
    return F.when(F.endswith(path, F.lit(".java")), "java").when(F.endswith(path, F.lit(".py")), "python")


def is_source(path, size):
    """A source suffix, no skipped folder above, and no generated giant."""
    skipped = F.arrays_overlap(directories(path), F.array(*map(F.lit, SKIP_DIRS)))
    return language(path).isNotNull() & ~skipped & (size <= MAX_FILE_BYTES)


def has_nul(content):
    """A zero byte among the first BINARY_PROBE ones."""
    probe = F.substring(content, 1, BINARY_PROBE)
    return F.position(F.unhex(F.lit("00")), probe) > 0


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, language) of the source files below root: tracked or not ignored if it is a git repository, else all but skipped folders."""
    names = tracked(root)
    rows = spark.createDataFrame([(n,) for n in (walked(root) if names is None else names)], "path string")
    return rows.where(is_source(F.col("path"), F.lit(0))).withColumn("language", language(F.col("path")))


def read_files(paths: DataFrame, root: str, contents: bool = True) -> DataFrame:
    """paths with size, mtime_ns and, if asked for, content of what is a regular file of no more than MAX_FILE_BYTES.

    The executors, which must see root, look at the files.
    """
    root = os.path.abspath(root)
    rest = [c for c in paths.columns if c != "path"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, rows = [], []
            for i, path in enumerate(batch.column(0).to_pylist()):
                try:
                    stat = os.lstat(f"{root}/{path}")
                    if not S_ISREG(stat.st_mode) or stat.st_size > MAX_FILE_BYTES:
                        continue
                    data = None
                    if contents:
                        with open(f"{root}/{path}", "rb") as f:
                            data = f.read()
                    rows.append((stat.st_size, stat.st_mtime_ns, data))
                    keep.append(i)
                except OSError:
                    continue
            some = batch.take(pa.array(keep, pa.int64()))
            columns = list(zip(*rows)) or [(), (), ()]
            made = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64())] + [pa.array(columns[2], pa.binary())] * contents
            yield pa.RecordBatch.from_arrays([*some.columns, *made], [*some.schema.names, "size", "mtime_ns", *["content"] * contents])

    given = paths.select("path", *rest)
    more = "size bigint, mtime_ns bigint" + ", content binary" * contents
    return given.mapInArrow(read, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema) + ", " + more)


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, language, size, mtime_ns, content) of the source files below root."""
    return read_files(listed(spark, root), root)


def walked(root: str) -> list[str]:
    """All files below root but for skipped folders."""
    out = []
    for folder, below, names in os.walk(root):
        below[:] = sorted(d for d in below if d not in SKIP_DIRS)
        out += [os.path.relpath(f"{folder}/{n}", root).replace(os.sep, "/") for n in names]
    return sorted(out)


def tracked(root: str) -> list[str] | None:
    """Names that git tracks or doesn't ignore; None outside a repository."""
    try:
        told = git(root, "ls-files", "--cached", "--others", "--exclude-standard", "-z")
    except (RuntimeError, FileNotFoundError):
        return None
    return sorted(set(told.decode(errors="replace").split("\0")) - {""})


def with_modules(files: DataFrame) -> DataFrame:
    """files with `module` and `is_package`: for Python by the packages of the same `version` (if there is such a column).

    A folder is a package if it has an __init__.py, or stands between such a folder and a file below that has none nearer.
    A file's module is the longest unbroken run of packages above it, and its own name.
    """
    by = [c for c in ("version",) if c in files.columns]
    parts = F.split("path", "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    py = files.where("language = 'python'").select(*by, "path", dirs.alias("dirs"))
    above = F.transform(F.sequence(F.lit(1), F.size("dirs")), lambda i: F.struct(i.alias("level"), F.array_join(F.slice("dirs", F.lit(1), i), "/").alias("dir")))
    levels = py.where(F.size("dirs") > 0).select(*by, "path", F.inline(above))
    own = py.where(F.endswith("path", F.lit("/__init__.py"))).select(*by, F.array_join("dirs", "/").alias("dir"), F.lit(True).alias("own")).distinct()
    nearest = levels.join(own, [*by, "dir"]).groupBy(*by, "path").agg(F.max("level").alias("nearest"))
    packages = levels.join(nearest, [*by, "path"]).where("level >= nearest").select(*by, "dir").distinct()
    broken = levels.join(packages, [*by, "dir"], "left_anti").groupBy(*by, "path").agg(F.max("level").alias("__broken"))
    rows = files.join(broken, [*by, "path"], "left").withColumn("__broken", F.coalesce("__broken", F.lit(0)))
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.py$", "")
    python, package = F.col("language") == "python", name == "__init__"
    inner = F.slice(dirs, F.col("__broken") + 1, F.greatest(F.size(dirs) - F.col("__broken"), F.lit(0)))
    module = F.when(package & (F.size(dirs) == 0), "__init__").otherwise(F.array_join(F.concat(inner, F.when(package, F.array().cast("array<string>")).otherwise(F.array(name))), "."))
    return rows.select(*files.columns, F.when(python, module).alias("module"), F.when(python, package).alias("is_package"))


def _struct(ddl: str) -> str:
    return "struct<" + ",".join(f"{p.split(' ')[0]}:{p.split(' ', 1)[1]}" for p in ddl.split(", ") if p.split(" ")[0] != "path") + ">"


EXTRACT = f"module string, has_errors boolean, symbols array<{_struct(SYMBOLS)}>, imports array<{_struct(IMPORTS)}>, refs array<{_struct(REFS)}>"


def extracted(files: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key..., path, language, extract columns) of (key..., path, language, module, is_package, content)."""
    key = key or []
    given = files.select(*key, "path", "language", "module", "is_package", "content")
    schema = StructType.fromDDL(", ".join([f"{c} {given.schema[c].dataType.simpleString()}" for c in [*key, "path", "language"]]) + ", " + EXTRACT)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                content = bytes(r["content"] or b"")
                got = extract_java(content) if r["language"] == "java" else extract_python(content, r["module"] or "", bool(r["is_package"]))
                rows.append({c: r[c] for c in [*key, "path", "language"]} | got)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    ship(files.sparkSession)
    return given.mapInArrow(run, schema)


def relation(rows: DataFrame, name: str, key: list[str] | None = None) -> DataFrame:
    """One of the relations symbols, imports and refs out of extracted rows."""
    return rows.select(*(key or []), "path", F.explode(name).alias("x")).select(*(key or []), "path", "x.*")


def tables_of(files: DataFrame) -> dict[str, DataFrame]:
    """The four relations of discovered files; binary ones are left out."""
    files = files.where(~has_nul(F.col("content")))
    files = files if "module" in files.columns else with_modules(files)
    rows = cut(extracted(files))
    facts = files.select("path", F.sha2("content", 256).alias("hash"), "size", "mtime_ns", line_count(F.decode("content", "utf-8")).cast("int").alias("line_count"))
    columns = columns_of(FILES)
    out = {"files": rows.select("path", "language", "module", "has_errors").join(facts, "path").select(*columns)}
    for name in ("symbols", "imports", "refs"):
        out[name] = relation(rows, name).select(*columns_of(TABLES[name]))
    return out


#: Files of a bucket when an index is built, buckets at most, and deltas of postings before they are merged.
BUCKET_FILES, MOST_BUCKETS, MOST_DELTAS = 256, 4096, 8
POSTINGS = "path string, ordinal int, len bigint, term string, tf bigint"
KEY = ["path", "ordinal"]


def bucket_of(path, buckets: int):
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


def indexed_words(symbols: DataFrame) -> DataFrame:
    """(path, ordinal, text): what word search finds a symbol by."""
    return symbols.select(*KEY, F.concat_ws(" ", "name", "qualified_name", "name_words").alias("text"))


class Tables(dict):
    """The relations of one version by name, with the statistics of its word search: documents, and tokens of all of them."""

    statistics: tuple[int, int] = (0, 0)


class Index:
    """A folder of tables in buckets of paths, and one manifest that names the version of each bucket.

    A refresh writes the buckets that hold a changed file, and nothing else; the other ones go on under their versions. The
    words of symbols are kept as postings in the order of their terms, so that a search reads the row groups of
    its prefixes only; a refresh adds a delta of postings and a list of the paths whose older postings are void, and
    both are merged when they are read. All files are complete before the manifest is replaced, and replacing
    a file is atomic, so readers see either the old tables or the new ones.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, os.path.abspath(folder)

    def manifest(self) -> dict | None:
        try:
            with open(f"{self.folder}/manifest.json", encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return None

    def published(self) -> Published | None:
        """The current version, as streaming.freshness asks for it."""
        m = self.manifest()
        return None if m is None else Published(m["version"], m["last_indexed_ns"] / 1e9)

    # --- reading ----------------------------------------------------------------------------

    def tables(self) -> Tables:
        m = self.manifest()
        if m is None:
            raise FileNotFoundError(f"no index in {self.folder}")
        if m["schema_version"] != SCHEMA_VERSION:
            raise ValueError("the index has another schema; build it anew")
        out = Tables({n: self._relation(m, n) for n in TABLES})
        out["postings"] = self._postings(m)
        out.statistics = tuple(m["statistics"])
        return out

    def _relation(self, m: dict, name: str, only: set[int] | None = None) -> DataFrame:
        """A relation, or some of its buckets."""
        at = [f"{self.folder}/{version}/{name}/bucket={b}" for b, version in m["tables"][name].items() if only is None or int(b) in only]
        return self.spark.read.schema(TABLES[name]).parquet(*at) if at else self.spark.createDataFrame([], TABLES[name])

    def _postings(self, m: dict) -> DataFrame:
        """Postings of all segments, without those of paths that a later segment declares void."""
        live, void = None, None
        for number, segment in reversed(list(enumerate(m["segments"]))):
            own = self.spark.read.schema(POSTINGS).parquet(f"{self.folder}/{segment}/postings")
            own = own if void is None else own.join(void, "path", "left_anti")
            live = own if live is None else live.unionByName(own)
            if number:
                gone = self.spark.read.schema("path string").parquet(f"{self.folder}/{segment}/void")
                void = gone if void is None else void.union(gone)
        return live

    # --- writing ----------------------------------------------------------------------------

    def _put(self, m: dict, rows: dict[str, DataFrame], touched: list[int]) -> None:
        """Write the touched buckets of each relation under the manifest's version."""
        for name, table in rows.items():
            dealt = table.withColumn("bucket", bucket_of("path", m["buckets"])).repartition(max(1, len(touched)), "bucket")
            dealt.sortWithinPartitions("bucket", "path").write.partitionBy("bucket").parquet(f"{self.folder}/{m['version']}/{name}")
            made = {d.removeprefix("bucket=") for d in os.listdir(f"{self.folder}/{m['version']}/{name}") if d.startswith("bucket=")}
            m["tables"].setdefault(name, {})
            for b in map(str, touched):
                m["tables"][name].pop(b, None)
                if b in made:
                    m["tables"][name][b] = m["version"]

    def _put_postings(self, m: dict, symbols: DataFrame) -> None:
        posts = search.postings(indexed_words(symbols), KEY, "text")
        posts.repartitionByRange("term").sortWithinPartitions("term", *KEY).write.parquet(f"{self.folder}/{m['version']}/postings")

    def _point(self, m: dict) -> None:
        with open(f"{self.folder}/manifest.new", "w", encoding="utf-8") as f:
            json.dump(m, f)
        os.replace(f"{self.folder}/manifest.new", f"{self.folder}/manifest.json")

    @staticmethod
    def _sizes(symbols: DataFrame) -> tuple[int, int]:
        """Documents of the word search, and their tokens."""
        r = indexed_words(symbols).agg(F.count("*").alias("n"), F.sum(F.size(tokens(F.col("text")))).alias("all")).first()
        return r["n"], r["all"] or 0

    def _build(self, root: str, found: DataFrame, started: int, batch: int | None) -> dict[str, int]:
        rows = tables_of(cut(read_files(with_modules(found), root)))
        n = rows["files"].count()
        buckets = 1 if n < 2 * BUCKET_FILES else 1 << (min(MOST_BUCKETS, n // BUCKET_FILES) - 1).bit_length()
        m = {"schema_version": SCHEMA_VERSION, "version": _version(started), "root": root, "last_indexed_ns": started, "buckets": buckets, "files": n, "tables": {}, "batch": batch}
        self._put(m, rows, list(range(buckets)))
        symbols = self._relation(m, "symbols")
        self._put_postings(m, symbols)
        self._point(m | {"segments": [m["version"]], "statistics": self._sizes(symbols)})
        return {"parse": n}

    def refresh(self, root: str, only: DataFrame | None = None, batch: int | None = None) -> dict[str, int]:
        """Bring the index up to date; files by action.

        only: paths to look at (column path); others aren't, but for Python files whose module has changed by these. batch:
        the number of a stream's micro-batch; one that was applied already changes nothing.
        """
        started = time.time_ns()
        os.makedirs(self.folder, exist_ok=True)
        m = self.manifest()
        found = listed(self.spark, root)
        if m is None or m["schema_version"] != SCHEMA_VERSION:
            return self._build(root, found, started, batch)
        if batch is not None and m["batch"] is not None and batch <= m["batch"]:
            return {}
        m = m | {"last_indexed_ns": started, "batch": m["batch"] if batch is None else batch, "was_indexed_ns": m["last_indexed_ns"]}
        old = {name: self._relation(m, name) for name in TABLES}
        was = old["files"].select("path", *[F.col(c).alias(f"__{c}") for c in ("module", "hash", "size", "mtime_ns")])
        quiet = (F.col("size") == F.col("__size")) & (F.col("mtime_ns") == F.col("__mtime_ns")) & (F.col("mtime_ns") < m["was_indexed_ns"] - RACY_NS)
        if only is None:
            # modules follow from the set of paths: with the same paths and quiet files, all is as it was
            n = read_files(found, root, contents=False).join(was, "path", "left").agg(F.count("*").alias("all"), F.count_if(quiet).alias("quiet")).first()
            if n["all"] == n["quiet"] == m["files"]:
                self._point(m)
                return {"unchanged": n["all"]}
            named = with_modules(found)
        else:
            named = with_modules(found)
            moved = named.join(was, "path").where((F.col("language") == "python") & ~F.col("module").eqNullSafe(F.col("__module"))).select("path")
            asked = cut(only.select("path").union(moved).distinct())
            named, was = named.join(asked, "path", "left_semi"), was.join(asked, "path", "left_semi")
        actions, now, doubtful = self._decided(m, root, named, was, quiet)
        counts = {r["action"]: r["n"] for r in actions.groupBy("action").agg(F.count("*").alias("n")).collect()}
        if set(counts) <= {"unchanged"}:
            self._point(m)
            return counts
        self._apply(m, started, old, actions, now, doubtful)
        return counts

    def _decided(self, m: dict, root: str, named: DataFrame, was: DataFrame, quiet) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(path and action of each file, what is known of the files now, contents of those that had to be read)."""
        seen = cut(read_files(named, root, contents=False).join(was, "path", "left"))
        # a Java file's module is written in it: what it was, if nothing else has changed
        module = F.when(F.col("language") == "java", F.col("__module")).otherwise(F.col("module"))
        same = F.coalesce(quiet & module.eqNullSafe(F.col("__module")), F.lit(False))
        doubtful = read_files(seen.where(~same).select("path", "language", "module", "is_package"), root)
        doubtful = cut(doubtful.where(~has_nul(F.col("content"))).withColumn("hash", F.sha2("content", 256)))
        sure = seen.where(same).select("path", module.alias("module"), F.col("__hash").alias("hash"), "size", "mtime_ns")
        read = doubtful.join(was.select("path", "__module", "__hash"), "path", "left")
        read_module = F.when(F.col("language") == "java", F.when(F.col("hash") == F.col("__hash"), F.col("__module"))).otherwise(F.col("module"))
        now = sure.union(read.select("path", read_module, "hash", "size", "mtime_ns"))
        known = was.select("path", *[F.col(f"__{c}").alias(c) for c in ("module", "hash", "size", "mtime_ns")])
        actions = refresh_cascade(known, now, last_run_ns=m["was_indexed_ns"], racy_ns=RACY_NS)
        # a doubtful file that turned out to be the same in all respects needs no new row
        alike = now.join(was, (now["path"] == was["path"]) & (F.col("size") == F.col("__size")) & (F.col("mtime_ns") == F.col("__mtime_ns"))).select(now["path"], F.lit(True).alias("__alike"))
        actions = actions.join(alike, "path", "left").select("path", F.when((F.col("action") == "stat") & F.col("__alike"), "unchanged").otherwise(F.col("action")).alias("action"))
        return cut(actions), now, doubtful

    def _apply(self, m: dict, started: int, old: dict[str, DataFrame], actions: DataFrame, now: DataFrame, doubtful: DataFrame) -> None:
        """Write the buckets of what has changed, the delta of postings, and the manifest."""
        changed = actions.where("action <> 'unchanged'")
        touched = sorted(r["b"] for r in changed.select(bucket_of("path", m["buckets"]).alias("b")).distinct().collect())  # as many as buckets at most
        parse, gone = actions.where("action = 'parse'").select("path"), actions.where("action in ('parse', 'remove')").select("path")
        stat = now.join(actions.where("action = 'stat'"), "path", "left_semi").select("path", F.col("size").alias("__s"), F.col("mtime_ns").alias("__t"))
        fresh = tables_of(doubtful.join(parse, "path", "left_semi").drop("hash"))
        version, merged = _version(started), {}
        for name in TABLES:
            kept = self._relation(m, name, set(touched)).join(gone, "path", "left_anti")
            if name == "files":
                kept = kept.join(stat, "path", "left").withColumns({"size": F.coalesce("__s", "size"), "mtime_ns": F.coalesce("__t", "mtime_ns")}).drop("__s", "__t")
            merged[name] = kept.select(*old[name].columns).unionByName(fresh[name].select(*old[name].columns))
        left, added = self._sizes(old["symbols"].join(gone, "path", "left_semi")), self._sizes(fresh["symbols"])
        m = m | {"version": version, "tables": {name: dict(of) for name, of in m["tables"].items()}, "statistics": [a - b + c for a, b, c in zip(m["statistics"], left, added)]}
        self._put(m, merged, touched)
        m["files"] = self._relation(m, "files").count()
        if len(m["segments"]) > MOST_DELTAS:
            self._put_postings(m, self._relation(m, "symbols"))
            m["segments"] = [version]
        else:
            self._put_postings(m, fresh["symbols"])
            gone.write.parquet(f"{self.folder}/{version}/void")
            m["segments"] = [*m["segments"], version]
        self._point(m)


def _version(started_ns: int) -> str:
    return f"v-{started_ns}-{uuid.uuid4().hex[:8]}"
