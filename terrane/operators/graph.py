"""The property graph: nodes (id, label, type) and edges (source, relation, target) as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ontology import safe_relation
from ..functions.text import norm_cypher, norm_legacy
from ..plans.steps import among, step


def star_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star schema's rows as nodes; orders and their years too."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    kinds = [
        ("region", "R", "r_regionkey", F.col("r_name"), "E53_Place"),
        ("nation", "N", "n_nationkey", F.col("n_name"), "E53_Place"),
        ("supplier", "S", "s_suppkey", F.col("s_name"), "E74_Group"),
        ("customer", "C", "c_custkey", F.col("c_name"), "E21_Person"),
        ("part", "P", "p_partkey", F.col("p_name"), "E22_Human-Made_Object"),
        ("orders", "O", "o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), "E5_Event"),
    ]
    out = None
    for name, letter, key, label, kind in kinds:
        rows = t(name).select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("id"), label.alias("label"), F.lit(kind).alias("type"))
        out = rows if out is None else out.unionByName(rows)
    years = t("orders").select(F.year("o_orderdate").cast("string").alias("y")).distinct()
    return out.unionByName(years.select(F.concat(F.lit("YEAR_"), "y").alias("id"), F.col("y").alias("label"), F.lit("E52_Time_Span").alias("type")))


def star_edges(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """Each edge once; or else those of line items as often as there are such, for what drops repeated edges itself. A
    filter by a few of the ends goes below the distinct rows, which so have strings for columns."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    end = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    edge = lambda df, a, rel, b: df.select(a.alias("source"), F.lit(rel).alias("relation"), b.alias("target"))
    place = "P53_has_former_or_current_location"
    only = lambda rows: rows.distinct() if once else rows
    parts = [
        edge(t("nation"), end("N", "n_nationkey"), place, end("R", "n_regionkey")),
        edge(t("supplier"), end("S", "s_suppkey"), place, end("N", "s_nationkey")),
        edge(t("customer"), end("C", "c_custkey"), place, end("N", "c_nationkey")),
        edge(t("orders"), end("O", "o_orderkey"), "P14_carried_out_by", end("C", "o_custkey")),
        only(edge(t("lineitem"), end("P", "l_partkey"), "P108_was_produced_by", end("S", "l_suppkey"))),
        only(edge(t("lineitem"), end("O", "l_orderkey"), "P46_is_composed_of", end("P", "l_partkey"))),
        edge(t("orders"), end("O", "o_orderkey"), "P4_has_time_span", F.concat(F.lit("YEAR_"), F.year("o_orderdate").cast("string"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def load_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes, with safe relation names, each once. Repeats go where edges lie by their source."""
    rows = edges.withColumn("relation", safe_relation(F.col("relation")))
    rows = rows.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").dropDuplicates(["source", "relation", "target"])
    return rows.join(nodes.select(F.col("id").alias("target")), "target", "left_semi").select("source", "relation", "target")


def repeated_ids(nodes: DataFrame) -> DataFrame:
    """Ids that break the graph's uniqueness constraint."""
    return nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges (src, relation, dst, forward) from either end."""
    forth = edges.select(F.col("source").alias("src"), "relation", F.col("target").alias("dst"), F.lit(True).alias("forward"))
    back = edges.select(F.col("target").alias("src"), "relation", F.col("source").alias("dst"), F.lit(False).alias("forward"))
    return forth.unionByName(back)


def first_of(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key. The rank filter is pushed into the window, which so keeps n rows for a key and
    task before the shuffle."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def nearest(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n different rows of each key, with their place as `order`; rows with equal columns `order` are the same.
    Rows that lie by key already are sorted once and neither move nor fill a hash table."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("order", F.dense_rank().over(w)).where(F.col("order") <= n)
    return rows.withColumn("__same", F.lag(F.struct(*order)).over(w).eqNullSafe(F.struct(*order))).where(~F.col("__same")).drop("__same")


def expand(start: DataFrame, edges: DataFrame, relations: list[str] | None = None, directed: bool = False, limit: int = 100, every: bool = False) -> DataFrame:
    """(id, relation, neighbour) of each start node (id), limit at most of each, ordered by relation and neighbour.
    Relations, if any, are filtered at the scan; edges may repeat. every: a start node without neighbours has a row of nulls."""
    edges = edges.where(F.col("relation").isin(relations)) if relations else edges
    ways = both_ways(edges) if not directed else edges.select(F.col("source").alias("src"), "relation", F.col("target").alias("dst"))
    start = start.select("id").distinct()
    if not every:  # else nearly all edges have a start node
        start = step(start)
        ways = among(ways, "src", start)
    # Start nodes are hashed, so that edges are sorted once, by id, relation and neighbour.
    found = ways.select(F.col("src").alias("id"), "relation", F.col("dst").alias("neighbour")).join(start.hint("shuffle_hash"), "id", "left_semi")
    found = nearest(found, ["id"], ["relation", "neighbour"], limit).drop("order")
    return start.join(found, "id", "left") if every else found


def path_ways(edges: DataFrame, directed: bool = False) -> DataFrame:
    """Edges (at, relation, dst, edge) from either end, or from their source; edge tells one from another."""
    ways = both_ways(edges).where("forward") if directed else both_ways(edges)
    edge = F.when(F.col("forward"), F.concat_ws("|", "src", "relation", "dst")).otherwise(F.concat_ws("|", "dst", "relation", "src"))
    return ways.select(F.col("src").alias("at"), "relation", "dst", edge.alias("edge"))


def path_starts(start: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return step(start.select(F.col("id").alias("at"), F.array("id").alias("nodes"), none.alias("relations"), none.alias("used")))


def longer(front: DataFrame, ways: DataFrame, per_node: int | None = None) -> DataFrame:
    """The paths of front (a step) with one more edge. Only the edges at their ends are looked at, so few move."""
    ways = among(ways, "at", front.select("at").distinct())
    ways = first_of(ways, ["at"], ["relation", "dst"], per_node) if per_node else ways
    front = front.join(ways, "at").where(~F.array_contains("used", F.col("edge")))
    return front.select(F.col("dst").alias("at"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("relations", F.array("relation")).alias("relations"), F.concat("used", F.array("edge")).alias("used"))


def paths(start: DataFrame, edges: DataFrame, depth: int, relations: list[str] | None = None, directed: bool = False, per_node: int | None = None, limit: int | None = None) -> DataFrame:
    """(nodes, relations) of every path of 1 to depth edges from the start nodes (id); no edge twice in a path. With
    per_node, paths go on along the first so many edges of a node only, by relation and neighbour: hubs have very many.
    With limit, each start node keeps so many paths: the shorter ones first, then by nodes and relations. As each path's
    start is a path too, no more than limit of a length ever go on."""
    ways = path_ways(edges.where(F.col("relation").isin(relations)) if relations else edges, directed)
    front, out = path_starts(start), None
    for at in range(1, depth + 1):
        front = longer(front, ways, per_node)
        if limit:
            front = first_of(front.withColumn("first", F.element_at("nodes", 1)), ["first"], ["nodes", "relations", "used"], limit).drop("first")
        front = step(front) if limit or at < depth else front
        out = front if out is None else out.unionByName(front)
    if limit:
        out = first_of(out.withColumn("first", F.element_at("nodes", 1)), ["first"], [F.size("relations"), "nodes", "relations"], limit)
    return out.select("nodes", "relations")


def first_paths(start: DataFrame, edges: DataFrame, depth: int, n: int) -> DataFrame:
    """(path): of the different paths of 1 to depth edges, each its nodes with ">" between them, the first n. A longer path
    comes after all that it starts with, so that only the first n of a length go on. Edges may repeat."""
    ways, front, out = path_ways(edges), path_starts(start), None
    for _ in range(depth):
        front = longer(front, ways).withColumn("path", F.array_join("nodes", ">"))
        # A task keeps its first n before they meet.
        front = front.withColumn("__n", F.dense_rank().over(Window.orderBy("path"))).where(F.col("__n") <= n).drop("__n")
        front = step(front.dropDuplicates(["path", "used"]))
        out = front.select("path") if out is None else out.unionByName(front.select("path"))
    return out.distinct().orderBy("path").limit(n)


def reach(start: DataFrame, edges: DataFrame, hops: int = 3, budget: int = 200) -> DataFrame:
    """(id, hop) by breadth-first steps along edges, new nodes only, in order of id, budget nodes at most in all."""
    edges = step(edges.select("source", "target"))  # each hop reads them again
    seen = step(start.select("id").distinct().withColumn("hop", F.lit(0)))
    front = seen
    for hop in range(1, hops + 1):
        room = budget - seen.count()
        if room <= 0:
            break
        new = front.select(F.col("id").alias("source")).join(edges, "source").select(F.col("target").alias("id")).distinct()
        front = step(new.join(seen, "id", "left_anti").orderBy("id").limit(room).withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            break
        seen = step(seen.unionByName(front))
    return seen


def label_search(nodes: DataFrame, keyword: str, limit: int = 10) -> DataFrame:
    """Nodes whose label contains the keyword, the shortest label first."""
    word = norm_legacy(F.lit(keyword))
    return nodes.where(F.contains(norm_cypher("label"), word)).orderBy(F.length("label"), "id").limit(limit)


def location_chain(nodes: DataFrame, edges: DataFrame, name: str, hops: int = 3, target: str | None = None) -> DataFrame:
    """Paths of places from nodes whose label contains name; with target, only those on which a label contains it."""
    start = nodes.where(F.contains(F.lower("label"), F.lit(name.lower()))).select("id")
    found = paths(start, edges, hops, ["P53_has_former_or_current_location"], directed=True).select(F.array_join("nodes", ">").alias("path"), F.size("relations").cast("long").alias("n_edges"))
    if target is None:
        return found
    at = found.select("path", "n_edges", F.explode(F.split("path", ">")).alias("id"))
    return at.join(nodes.where(F.contains(F.lower("label"), F.lit(target.lower()))).select("id"), "id", "left_semi").select("path", "n_edges").distinct()


def neighbourhood(nodes: DataFrame, edges: DataFrame, pattern: str, most_nodes: int = 5, most_edges: int = 10) -> DataFrame:
    """(kind, source, relation, target): the first nodes by id whose label matches the pattern, as (id, null, label), and
    the first edges from either end of all nodes that match, by labels."""
    hit = step(nodes.where(F.rlike("label", F.lit(pattern))).select("id", "label"))
    rows = hit.orderBy("id").limit(most_nodes).select(F.lit("node").alias("kind"), F.col("id").alias("source"), F.lit(None).cast("string").alias("relation"), F.col("label").alias("target"))
    ways = among(both_ways(edges).select(F.col("src").alias("id"), "relation", "dst"), "id", hit.select("id"))
    ways = step(ways.join(hit.withColumnRenamed("label", "source"), "id").select("source", "relation", "dst"))
    ends = among(nodes.select(F.col("id").alias("dst"), F.col("label").alias("target")), "dst", ways.select("dst"))
    linked = ways.join(ends, "dst").orderBy("source", "relation", "target").limit(most_edges).select(F.lit("edge").alias("kind"), "source", "relation", "target")
    return rows.unionByName(linked)


def run_sql(nodes: DataFrame, edges: DataFrame, sql: str) -> DataFrame:
    """A query of one's own in Spark SQL over {nodes} and {edges}."""
    return nodes.sparkSession.sql(sql, nodes=nodes, edges=edges)
