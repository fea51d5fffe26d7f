"""Call graph operators: reachability, call trees, shortest stacks, callers, cycles, ancestors.

Closures are frontier rounds of joins. Every few rounds the lineage is cut by a checkpoint in the shared folder. Reach keeps
one narrow row per (root, node); only operators that return paths carry them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .matching import suffixes


def shared_checkpoints(spark) -> None:
    """Lets checkpoint() work: the folder that spark.checkpoint.dir names; a local session without one gets a temporary folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        found, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
        if not found and master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="lineloom-"))


def kept(df: DataFrame) -> DataFrame:
    """df written once as Parquet to the shared folder, for plans that read it in many places; it goes when the driver ends."""
    spark = df.sparkSession
    shared_checkpoints(spark)
    sc = spark.sparkContext
    at = f"{sc.getCheckpointDir()}/kept-{uuid.uuid4().hex}"
    path = sc._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def build(edges: DataFrame) -> DataFrame:
    """Distinct (caller, callee) edges; nodes exist only in edges, parallel edges collapse."""
    return edges.select("caller", "callee").where("caller is not null and callee is not null").distinct()


def counts(edges: DataFrame) -> DataFrame:
    """(n_nodes, n_edges) of a graph."""
    e = build(edges)
    nodes = e.select(F.explode(F.array("caller", "callee")).alias("n"))
    return nodes.agg(F.count_distinct("n").alias("n_nodes"), (F.count("*") / 2).cast("long").alias("n_edges"))


def reach(edges: DataFrame, roots: DataFrame, max_depth: int = 20, cut_every: int = 4) -> DataFrame:
    """(root, node, depth): nodes within max_depth of each root (a column node) with their least depth."""
    shared_checkpoints(edges.sparkSession)
    edges = build(edges).checkpoint()
    frontier = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")).distinct()
    reached = frontier
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["caller"]).select("root", F.col("callee").alias("node")).distinct()
        frontier = step.join(reached.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(depth).alias("depth")).checkpoint()
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
        if depth % cut_every == 0:
            reached = reached.checkpoint()
    return reached


def shortest_paths(edges: DataFrame, roots: DataFrame, max_depth: int = 20, cut_every: int = 4) -> DataFrame:
    """(root, node, depth, path): for every node within max_depth of a root the shortest path, the least in order of several."""
    frontier = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"), F.array("node").alias("path"))
    reached = frontier
    shared_checkpoints(edges.sparkSession)
    edges = build(edges).checkpoint()
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["caller"]).select("root", F.col("callee").alias("node"), F.lit(depth).alias("depth"), F.concat("path", F.array("callee")).alias("path"))
        step = step.groupBy("root", "node").agg(F.first("depth").alias("depth"), F.min("path").alias("path"))
        frontier = step.join(reached.select("root", "node"), ["root", "node"], "left_anti").checkpoint()
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
        if depth % cut_every == 0:
            reached = reached.checkpoint()
    return reached


def call_tree(edges: DataFrame, roots: DataFrame, max_depth: int = 10) -> DataFrame:
    """(root, node, depth, path, is_circular): all simple paths from each root, at most max_depth deep.

    A node that is on the path already is one circular leaf. There are as many rows as paths; use reach() for what is
    reached alone.
    """
    shared_checkpoints(edges.sparkSession)
    edges = build(edges).checkpoint()
    frontier = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"), F.array("node").alias("path"), F.lit(False).alias("is_circular")).distinct()
    tree = frontier
    for depth in range(1, max_depth + 1):
        step = frontier.where("not is_circular").select("root", "node", "path").join(edges, F.col("node") == F.col("caller"))
        frontier = step.select("root", F.col("callee").alias("node"), F.lit(depth).alias("depth"), F.concat("path", F.array("callee")).alias("path"), F.array_contains("path", F.col("callee")).alias("is_circular")).checkpoint()
        if frontier.isEmpty():
            break
        tree = tree.unionByName(frontier)
    return tree


def printed(tree: DataFrame, layers: DataFrame | None = None) -> DataFrame:
    """(root, place, line) of call_tree(): indented lines in depth-first order, with [layer] tags from (node, layer)."""
    if layers is not None:
        tree = tree.join(layers.select("node", "layer"), "node", "left")
    tag = F.coalesce(F.concat(F.lit(" ["), F.col("layer"), F.lit("]")), F.lit("")) if layers is not None else F.lit("")
    line = F.concat(F.expr("repeat('  ', depth)"), F.col("node"), tag, F.when(F.col("is_circular"), " (circular)").otherwise(""))
    return tree.select("root", (F.row_number().over(Window.partitionBy("root").orderBy("path"))).alias("place"), line.alias("line"))


def paths_to(tree: DataFrame, suffix: str) -> DataFrame:
    """Rows of call_tree() whose last node ends with the suffix."""
    return tree.where(~F.col("is_circular") & F.col("node").endswith(suffix))


def callers(edges: DataFrame, targets: DataFrame, max_depth: int = 20) -> DataFrame:
    """Reach against the edges: (root, node, depth) of what calls each target."""
    return reach(edges.select(F.col("callee").alias("caller"), F.col("caller").alias("callee")), targets, max_depth)


def start_nodes(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, node): the node of that name, else the first that ends with it after a dot, else the first with the same last name."""
    nodes = build(edges).select(F.explode(F.array("caller", "callee")).alias("node")).distinct()
    ends = nodes.select("node", F.explode(suffixes(F.col("node"))).alias("end"))
    # one row for each end, so that a name that many nodes share meets each wanted name once
    ends = ends.groupBy("end").agg(F.min(F.struct(F.when(F.col("node") == F.col("end"), 0).otherwise(1).alias("way"), "node")).alias("whole"), F.min("node").alias("node"))
    asked = wanted.select("wanted").distinct()
    whole = asked.join(ends, F.col("wanted") == F.col("end")).select("wanted", "whole.node", "whole.way")
    named = asked.join(ends, F.substring_index("wanted", ".", -1) == F.col("end")).select("wanted", "node", F.lit(2).alias("way"))
    return whole.unionByName(named).groupBy("wanted").agg(F.min(F.struct("way", "node"))["node"].alias("node"))


def callers_with_layers(edges: DataFrame, wanted: DataFrame, nodes: DataFrame, max_depth: int = 20) -> DataFrame:
    """(wanted, layer, files): what calls each wanted method, by layer, for nodes (node, layer, file); Unknown is left out."""
    shared_checkpoints(edges.sparkSession)
    edges = build(edges).checkpoint()
    start = start_nodes(edges, wanted).checkpoint()
    up = callers(edges, start.select("node").distinct(), max_depth)
    found = start.join(up.select(F.col("root").alias("node"), F.col("node").alias("caller")), "node").join(nodes.select(F.col("node").alias("caller"), "layer", "file"), "caller")
    found = found.where("layer <> 'Unknown' and file is not null")
    return found.groupBy("wanted", F.lower("layer").alias("layer")).agg(F.array_sort(F.collect_set("file")).alias("files"))


def cycles(edges: DataFrame, steps: int = 4) -> DataFrame:
    """(node, component) of strongly connected components of two nodes or more, however long; component is the least node.

    Forward-backward colouring: what has no edge in or out goes; each node takes the least node that reaches it as its
    colour; what reaches its own colour's node within the colour is that node's component; the rest is coloured again.
    Work and rows are in proportion to the edges in each round; `steps` rounds stand in one plan.
    """
    left = build(edges).where("caller <> callee")
    shared_checkpoints(left.sparkSession)
    left, found = left.checkpoint(), None
    while not left.isEmpty():
        before = -1
        while (now := left.count()) != before:  # nodes without an edge in or out lie in no cycle
            before = now
            for _ in range(steps):
                ends = left.select(F.col("callee").alias("n")).intersect(left.select(F.col("caller").alias("n")))
                left = left.join(ends.withColumnRenamed("n", "caller"), "caller", "left_semi").join(ends.withColumnRenamed("n", "callee"), "callee", "left_semi").select("caller", "callee")
            left = left.checkpoint()
        if not before:
            break
        colour = left.select(F.col("caller").alias("node")).distinct().withColumn("colour", F.col("node")).checkpoint()
        while True:
            was = colour
            for _ in range(steps):
                offered = colour.withColumnRenamed("node", "caller").join(left, "caller").select(F.col("callee").alias("node"), "colour")
                colour = colour.unionByName(offered).groupBy("node").agg(F.min("colour").alias("colour"))
            colour = colour.checkpoint()
            if colour.exceptAll(was).isEmpty():
                break
        # edges within a colour, walked backward from its least node
        c = colour
        inner = left.join(c.select(F.col("node").alias("caller"), F.col("colour").alias("c1")), "caller").join(c.select(F.col("node").alias("callee"), F.col("colour").alias("c2")), "callee").where("c1 = c2").select("caller", "callee").checkpoint()
        back = c.where("node = colour").checkpoint()
        while True:
            n = back.count()
            for _ in range(steps):
                more = back.withColumnRenamed("node", "callee").join(inner, "callee").select(F.col("caller").alias("node"), "colour")
                back = back.unionByName(more).distinct()
            back = back.checkpoint()
            if back.count() == n:
                break
        size = back.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1")
        part = back.join(size, "colour", "left_semi").select("node", F.col("colour").alias("component"))
        found = part if found is None else found.unionByName(part)
        done = back.select("node")
        left = inner.join(done.withColumnRenamed("node", "caller"), "caller", "left_anti").join(done.withColumnRenamed("node", "callee"), "callee", "left_anti").select("caller", "callee").checkpoint()
    if found is None:
        return build(edges).select(F.col("caller").alias("node"), F.col("caller").alias("component")).where("false")
    return found


def ancestors(parents: DataFrame, max_depth: int = 100) -> DataFrame:
    """(node, ancestor, depth) of (node, parent) rows, nearest first; stops at Object, at a node without parent and where it would go round."""
    up = parents.where("parent is not null and parent <> 'Object'").select("node", "parent").distinct()
    shared_checkpoints(up.sparkSession)
    frontier = up.select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"), F.array("node", "parent").alias("path")).where("node <> parent")
    out = frontier
    for depth in range(2, max_depth + 1):
        step = frontier.join(up.select(F.col("node").alias("ancestor"), "parent"), "ancestor").where(~F.array_contains("path", F.col("parent")))
        frontier = step.select("node", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth"), F.concat("path", F.array("parent")).alias("path")).checkpoint()
        if frontier.isEmpty():
            break
        out = out.unionByName(frontier)
    return out.select("node", "ancestor", "depth")


def method_endpoints(closure: DataFrame, methods: DataFrame) -> DataFrame:
    """(method, endpoint): endpoints that are the method; for methods without, endpoints whose closure holds it."""
    direct = methods.join(closure.where("depth = 0"), methods["method"] == F.col("node")).select("method", F.col("root").alias("endpoint"))
    rest = methods.join(direct.select("method").distinct(), "method", "left_anti")
    inner = rest.join(closure.where("depth > 0"), rest["method"] == F.col("node")).select("method", F.col("root").alias("endpoint"))
    return direct.unionByName(inner).distinct()


def edges_of_paths(tree: DataFrame) -> DataFrame:
    """The (caller, callee) edges of saved paths."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.get("path", i - 1).alias("caller"), F.get("path", i).alias("callee")))
    return tree.where("size(path) > 1").select(F.explode(pairs).alias("e")).select("e.*").distinct()


def one_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row of each key in an explicit order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")
