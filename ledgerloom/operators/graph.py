"""Directed graphs of dependencies: edges (src, dst, relation)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import checkpointed


def predecessors(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("dst") == node).select("src", "relation").distinct()


def successors(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("src") == node).select("dst", "relation").distinct()


def transitive(edges: DataFrame, node: str, backwards: bool = False) -> DataFrame:
    """node, depth of everything reachable: breadth-first rounds of one join each; known nodes are not visited again."""
    a, b = ("dst", "src") if backwards else ("src", "dst")
    links = edges.select(F.col(a).alias("at"), F.col(b).alias("next")).distinct()
    spark = edges.sparkSession
    seen = spark.createDataFrame([(node, 0)], "node string, depth int")
    frontier, depth = seen, 0
    while True:
        depth += 1
        step = links.join(frontier.select(F.col("node").alias("at")), "at").select(F.col("next").alias("node")).distinct()
        frontier = checkpointed(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = checkpointed(seen.unionByName(frontier))
    return seen.where("depth > 0")


def shortest_path(edges: DataFrame, start: str, goal: str) -> list[str]:
    """Nodes of a shortest directed path (of several the one whose nodes come first), empty if there is none."""
    if start == goal:
        return [start]
    links = edges.select("src", "dst").distinct()
    seen = edges.sparkSession.createDataFrame([(start, [start])], "node string, path array<string>")
    frontier = seen
    while True:
        step = links.join(frontier.select(F.col("node").alias("src"), "path"), "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        frontier = checkpointed(step.join(seen.select("node"), "node", "left_anti"))
        if frontier.isEmpty():
            return []
        hit = frontier.where(F.col("node") == goal).first()
        if hit:
            return list(hit.path)
        seen = checkpointed(seen.select("node", F.lit(None).cast("array<string>").alias("path")).unionByName(frontier))


def join_path(edges: DataFrame, start: str, goal: str) -> DataFrame:
    """step, src, dst, detail: the references to join along, from one table to another (edges: src, dst, relation, detail)."""
    path = shortest_path(edges, start, goal)
    steps = edges.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(path, path[1:]), 1)], "step int, src string, dst string")
    return F.broadcast(steps).join(edges.select("src", "dst", "detail"), ["src", "dst"]).groupBy("step", "src", "dst").agg(F.min("detail").alias("detail"))


def cyclic_core(edges: DataFrame) -> DataFrame:
    """Edges that lie on cycles or on ways between them: nodes without a way in or a way out are dropped until none is left.
    Empty exactly if the graph has no cycle."""
    core = checkpointed(edges.select("src", "dst").distinct())
    size = -1
    while (count := core.count()) != size:
        size = count
        inner = core.select(F.col("src").alias("n")).intersect(core.select(F.col("dst").alias("n")))
        core = checkpointed(core.join(inner.select(F.col("n").alias("src")), "src", "left_semi").join(inner.select(F.col("n").alias("dst")), "dst", "left_semi"))
    return core


def cycles(edges: DataFrame, max_length: int | None = None) -> DataFrame:
    """path: simple cycles, each once, starting at its least node; only those up to a length if one is given (their number
    can grow beyond measure).  Looked for in the cyclic core only; ends when no path can be made longer."""
    links = cyclic_core(edges.where("src <> dst"))
    paths = links.where("src < dst").select(F.array("src", "dst").alias("path"))
    found, length = None, 1
    while max_length is None or length < max_length:
        length += 1
        grown = paths.withColumn("at", F.element_at("path", -1)).join(links, F.col("at") == F.col("src")).select("path", "dst")
        closed = checkpointed(grown.where(F.col("dst") == F.col("path")[0]).select("path"))
        found = closed if found is None else found.unionByName(closed)
        paths = checkpointed(grown.where((F.col("dst") > F.col("path")[0]) & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path")))
        if paths.isEmpty():
            break
    return paths.limit(0) if found is None else found


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, in_degree, out_degree; nodes without edges included."""
    ends = edges.select("src", "dst").distinct().select(F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))))
    all_ = nodes.select("node", F.lit(0).alias("i"), F.lit(0).alias("o"))
    return ends.unionByName(all_).groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes, edges, density, unused (nothing points there), roots (leaves that something points to)."""
    d = degrees(edges, nodes)
    n_edges = edges.select("src", "dst").distinct().agg(F.count(F.lit(1)).alias("edges"))
    per = d.agg(F.count(F.lit(1)).alias("nodes"), F.count(F.when(F.col("in_degree") == 0, 1)).alias("unused"), F.count(F.when((F.col("out_degree") == 0) & (F.col("in_degree") > 0), 1)).alias("roots"))
    density = F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0)
    return per.join(n_edges).select("nodes", "edges", F.round(density, 8).alias("density"), "unused", "roots")


def call_edges(code: DataFrame, key: str, text: str) -> DataFrame:
    """caller module, called module and method of every qualified call ``Module.Method(`` outside comments."""
    bare = F.regexp_replace(F.col(text), r"//[^\r\n]*", "")
    calls = F.regexp_extract_all(bare, F.lit(r"(?U)(?<![\w.\"])(\p{Lu}\w+\.\p{Lu}\w+)\s*\("), F.lit(1))
    pair = F.split(F.col("call"), r"\.")
    return code.select(F.col(key).cast("string").alias("caller"), F.explode(calls).alias("call")).select("caller", pair[0].alias("module"), pair[1].alias("method"))
