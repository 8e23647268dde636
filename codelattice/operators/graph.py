"""The module graph: edges, importers, strongly connected components and shortest loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut

#: Edges of a graph whose labels, two for each at most, are broadcast.
BROADCAST_EDGES = 100_000


def edge_weights(imports: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return imports.where(F.col(src) != F.col(dst)).groupBy(src, dst).agg(F.count("*").alias("n"))


def importers(edges: DataFrame, k: int) -> DataFrame:
    """The k modules with the most distinct importers."""
    return edges.groupBy("dst").agg(F.countDistinct("src").alias("n_importers")).orderBy(F.desc("n_importers"), "dst").limit(k)


def edge_examples(imports: DataFrame, order: list[str], text: str, deferred: str) -> DataFrame:
    """One import for each edge: the first at top level, else the first deferred one."""
    first = F.min_by(text, F.struct(F.col(deferred), *order))
    return imports.where("src <> dst").groupBy("src", "dst").agg(first.alias("example"))


def import_targets(imports: DataFrame, modules: DataFrame, types: DataFrame) -> DataFrame:
    """imports with `target`: in Python the module `module.name`, else `module`; in Java `module`, else the module of that type; null outside."""
    named = (F.col("language") == "python") & F.col("name").isNotNull() & (F.col("name") != "*")
    full = F.when(named, F.concat_ws(".", "module", "name")).otherwise(F.col("module"))
    rows = imports.withColumn("__full", full)
    m = modules.select(F.col("module").alias("__m")).distinct()
    rows = rows.join(m.withColumnRenamed("__m", "__a"), F.col("__full") == F.col("__a"), "left").join(m.withColumnRenamed("__m", "__b"), F.col("module") == F.col("__b"), "left")
    t = types.groupBy(F.col("qualified_name").alias("__q")).agg(F.max_by("module", F.struct("path", "ordinal")).alias("__c"))
    by_type = F.when(F.col("language") == "java", F.col("module"))
    rows = rows.withColumn("__t", by_type).join(t, F.col("__t") == F.col("__q"), "left")
    return rows.withColumn("target", F.coalesce("__a", "__b", "__c")).drop("__full", "__a", "__b", "__c", "__q", "__t")


def _by(df: DataFrame, edges: int, **names: str) -> DataFrame:
    """Columns of a table with at most two rows an edge under new names, marked for broadcast if the edges are counted and few."""
    out = df.select(*[F.col(old).alias(new) for new, old in names.items()])
    return F.broadcast(out) if edges <= BROADCAST_EDGES else out


def _trimmed(edges: DataFrame, n: int) -> tuple[DataFrame, int]:
    """The edges whose nodes all have an edge in and one out, and how many they are."""
    while n:
        ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("end")).select("end.*")
        inner = ends.groupBy("node").agg(F.max("o").alias("o"), F.max("i").alias("i")).where("o = 1 and i = 1")
        left = edges.join(_by(inner, n, src="node"), "src", "left_semi").join(_by(inner, n, dst="node"), "dst", "left_semi")
        edges, was = cut(left.select("src", "dst")), n
        n = edges.count()
        if n == was:
            break
    return edges, n


def _extreme_labels(edges: DataFrame, nodes: DataFrame, n: int, a: str, b: str) -> DataFrame:
    """(node, label): the least node from which a path along a -> b leads to node; itself included. n: edges at most."""
    labels = nodes.select("node", F.col("node").alias("label"))
    while True:
        told = edges.join(_by(labels, n, **{a: "node", "near": "label"}), a).select(F.col(b).alias("node"), "near", F.lit(None).cast(labels.schema["label"].dataType).alias("was"))
        step = told.union(labels.select("node", "label", "label")).groupBy("node").agg(F.min("near").alias("near"), F.max("was").alias("was"))
        # what leads to a node's label leads to the node: labels of labels double the length of the paths that are known
        moved = cut(step.join(_by(labels, n, near="node", far="label"), "near").select("node", "was", F.least("near", "far").alias("label")))
        labels = moved.select("node", "label")
        if moved.where("label <> was").isEmpty():
            return labels


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component, size) of strongly connected components of two nodes or more; named by the least node.

    Nodes without an edge in or out are trimmed again and again; of the rest, every node that is
    reached from and reaches the same least node belongs to that node's component. Found ones leave
    the graph, and so do edges between nodes of different colours, until no edge is left.
    Labels are broadcast while at most BROADCAST_EDGES edges are left, and shuffled beyond.
    """
    edges = cut(edges.where("src <> dst").select("src", "dst").distinct())
    found, n = None, edges.count()
    while True:
        edges, n = _trimmed(edges, n)
        if not n:
            break
        nodes = cut(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
        colour = _extreme_labels(edges, nodes, n, "src", "dst")
        inner = cut(edges.join(_by(colour, n, src="node", x="label"), "src").join(_by(colour, n, dst="node", y="label"), "dst").where("x = y").select("src", "dst"))
        back = _extreme_labels(inner, nodes, n, "dst", "src")
        own = cut(colour.join(_by(back, n, node="node", back="label"), "node").where("back = label").select("node", F.col("label").alias("component")))
        found = own if found is None else found.union(own)
        edges = cut(inner.join(_by(own, n, src="node"), "src", "left_anti").join(_by(own, n, dst="node"), "dst", "left_anti").select("src", "dst"))
        n = edges.count()
    if found is None:
        found = edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    sizes = found.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    return found.join(sizes, "component").select("node", "component", "size")


def shortest_loops(edges: DataFrame, components: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(component, loop): for each component, the least of the shortest loops through its least node.

    With starts (component, start), only their components have loops, through these nodes.
    A search by levels inside each component keeps, for every node, the least path that reaches it first.
    """
    of = components.select("node", "component")
    inner = cut(edges.select("src", "dst").distinct().join(of.select(F.col("node").alias("src"), "component"), "src").join(of.select(F.col("node").alias("dst"), F.col("component").alias("__c")), "dst").where("component = __c").select("component", "src", "dst"))
    if starts is None:
        starts = inner.select("component", F.col("component").alias("start")).distinct()
    paths = starts.select("component", F.col("start").alias("node"), F.array("start").alias("path"))
    seen = paths.select("component", "node")
    loops = None
    while True:
        step = paths.join(inner.withColumnRenamed("src", "node"), ["component", "node"]).select("component", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        step = cut(step.groupBy("component", "node").agg(F.min("path").alias("path")))
        closed = step.where("node = path[0]").select("component", F.col("path").alias("loop"))
        loops = closed if loops is None else loops.union(closed.join(loops, "component", "left_anti"))
        paths = cut(step.join(seen, ["component", "node"], "left_anti").join(loops, "component", "left_anti"))
        if not paths.limit(1).count():
            return loops
        seen = cut(seen.union(paths.select("component", "node")))


def group_degrees(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(group, out_edges, in_edges): edges that cross the border of each group; inner ones are hidden."""
    m = members.select("node", "group")
    rows = edges.join(m.select(F.col("node").alias("src"), F.col("group").alias("a")), "src", "left").join(m.select(F.col("node").alias("dst"), F.col("group").alias("b")), "dst", "left").where(~F.col("a").eqNullSafe(F.col("b")))
    both = rows.where("a is not null").select(F.col("a").alias("group"), F.col("n").alias("o"), F.lit(0).alias("i")).union(rows.where("b is not null").select("b", F.lit(0), "n"))
    return both.groupBy("group").agg(F.sum("o").alias("out_edges"), F.sum("i").alias("in_edges"))
