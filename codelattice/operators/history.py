"""Change frequency: churn that follows renames, and its product with size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

#: Lifetimes of a name up to which a join on the name is small.
FEW = 16
_NAME = ["repo", "name"]
_ID = ["repo", "name", "at"]


def lifetimes(touches: DataFrame) -> DataFrame:
    """(repo, name, at, until, via): what a name stood for before (in time) each change of its meaning.

    A rename at position at gives the old name the meaning that the new one, `via`, has just before; an addition or a rename ends the
    meaning of the name that it made (via is null). at and until are (pos, k, step), growing into the past: the row holds for
    what is older than at, as far as until (null: for ever).
    """
    rows = touches.where("status in ('A', 'R')")
    step = lambda n: F.struct("pos", "k", F.lit(n).alias("step")).alias("at")
    old = rows.where("status = 'R' and old_path is not null").select("repo", F.col("old_path").alias("name"), step(0), F.col("path").alias("via"))
    made = rows.select("repo", F.col("path").alias("name"), step(1), F.lit(None).cast("string").alias("via"))
    return old.union(made).withColumn("until", F.lead("at").over(Window.partitionBy(*_NAME).orderBy("at"))).select(*_ID, "until", "via")


def meanings(lives: DataFrame) -> DataFrame:
    """(repo, name, at, today): what the names of lifetimes are called today, null if their file is gone.

    Each rename points to the lifetime that its new name had just before. Pointers are followed by doubling: a chain of n
    renames takes log2(n) joins, whatever the number of repositories and files.
    """
    moved = lives.where("via is not null").select("repo", F.col("via").alias("name"), "at", F.struct("name", "via").alias("asker"))
    both = moved.unionByName(lives.select("repo", "name", "at", F.lit(None).cast(moved.schema["asker"].dataType).alias("asker")))
    before = Window.partitionBy(*_NAME).orderBy("at", F.col("asker").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    began = F.last(F.when(F.col("asker").isNull(), F.col("at")), ignorenulls=True).over(before)
    found = both.withColumn("p_at", began).where("asker is not null").select("repo", F.col("asker.name").alias("name"), "at", F.col("asker.via").alias("via"), "p_at")
    ended = lives.where("via is null").select(*_ID, F.lit(None).cast("string").alias("to"), F.lit(None).cast(lives.schema["at"].dataType).alias("p_at"))
    state = cut(found.select(*_ID, F.col("via").alias("to"), "p_at").union(ended))
    while True:
        if not state.where("p_at is not null").limit(1).count():
            return state.select(*_ID, F.col("to").alias("today"))
        ahead = state.select("repo", F.col("name").alias("to"), F.col("at").alias("p_at"), F.col("to").alias("n_to"), F.col("p_at").alias("n_at"))
        follow = state.where("p_at is not null").join(ahead, ["repo", "to", "p_at"]).select(*_ID, F.col("n_to").alias("to"), F.col("n_at").alias("p_at"))
        state = cut(state.where("p_at is null").union(follow))


def churn(touches: DataFrame, repo: str = "repo") -> DataFrame:
    """(repo, path, churn, last): commits that touched what is called path today, and the newest one's time.

    touches: (repo, pos, time, status, path, old_path), pos 0 being the newest commit, and k, the place of a row in its
    commit. A commit's paths have the meaning that its newer neighbours left them with; those whose file was made again later count for no name.
    Only names that were renamed or added have lifetimes; all others stand for themselves. One repository is as many tasks as its names need.
    """
    rows = touches.select(F.col(repo).alias("repo"), F.col("pos").cast("bigint").alias("pos"), F.col("time").cast("bigint").alias("time"), "status", "path", "old_path", F.col("k") if "k" in touches.columns else F.lit(0).alias("k"))
    lives = cut(lifetimes(rows))
    known = lives.join(meanings(lives), _ID).select("repo", F.col("name").alias("path"), F.col("at.pos").alias("after"), F.col("until.pos").alias("until"), "today").where("until is null or after < until")
    each = rows.groupBy("repo", "path", "pos").agg(F.min_by("time", "k").alias("time"))
    many = known.groupBy("repo", "path").agg(F.count("*").alias("n")).where(F.col("n") > FEW).select("repo", "path")
    # names of few lifetimes meet them by a join that may be split; those of many are swept in order
    few = each.join(many, ["repo", "path"], "left_anti").join(known.join(many, ["repo", "path"], "left_anti"), ["repo", "path"], "left")
    inside = (F.col("after") < F.col("pos")) & (F.col("until").isNull() | (F.col("pos") <= F.col("until")))
    few = few.groupBy("repo", "path", "pos", "time").agg(F.max(F.when(inside, F.struct("after", "today"))).alias("life"))
    life = F.struct("after", "today")
    events = each.join(many, ["repo", "path"], "left_semi").withColumn("life", F.lit(None).cast("struct<after:bigint,today:string>"))
    events = events.unionByName(known.join(many, ["repo", "path"], "left_semi").select("repo", "path", F.col("after").alias("pos"), F.lit(None).cast("bigint").alias("time"), life.alias("life")))
    sweep = Window.partitionBy("repo", "path").orderBy("pos", F.col("life").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = events.select("repo", "path", "pos", "time", F.last("life", ignorenulls=True).over(sweep).alias("life"), F.col("life").isNull().alias("asks")).where("asks").drop("asks")
    named = few.unionByName(swept)
    name = F.when(F.col("life").isNull(), F.col("path")).otherwise(F.col("life.today"))
    named = named.select("repo", name.alias("path"), "pos", "time").where("path is not null")
    each = named.groupBy("repo", "path", "pos").agg(F.min("time").alias("time"))
    return each.groupBy("repo", "path").agg(F.count("*").alias("churn"), F.min_by("time", "pos").alias("last"))


def hotspots(changes: DataFrame, sizes: DataFrame, key: list[str]) -> DataFrame:
    """key, churn, size and their product, of what has both; the largest product first."""
    rows = changes.join(sizes, key).withColumn("score", F.col("churn") * F.col("size"))
    return rows.orderBy(F.desc("score"), F.desc("churn"), *key)


def refresh_cascade(known: DataFrame, found: DataFrame, key: str = "path", last_run_ns: int | None = None, racy_ns: int = 2_000_000_000) -> DataFrame:
    """(key, action): unchanged, stat, parse or remove, from (key, module, hash, size, mtime_ns) of both sides.

    Equal size and time count as unchanged unless the file is so new that it may have changed in the same tick.
    """
    a = known.select(key, *[F.col(c).alias(f"__a_{c}") for c in ("module", "hash", "size", "mtime_ns")])
    b = found.select(key, *[F.col(c).alias(f"__b_{c}") for c in ("module", "hash", "size", "mtime_ns")])
    same = lambda c: F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}"))
    racy = F.lit(False) if last_run_ns is None else F.col("__b_mtime_ns") >= last_run_ns - racy_ns
    action = (
        F.when(F.col("__b_hash").isNull(), "remove")
        .when(F.col("__a_hash").isNull(), "parse")
        .when(same("module") & ~racy & same("size") & same("mtime_ns"), "unchanged")
        .when(same("module") & same("hash"), "stat")
        .otherwise("parse")
    )
    return a.join(b, key, "full_outer").select(key, action.alias("action"))
