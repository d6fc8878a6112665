"""Beam search over the graph, for all questions at once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.ontology import canonical_relation, relation_codes
from ..plans.steps import among, step
from .graph import both_ways, first_of, nearest
from .rank import adaptive_width, path_score, relation_similarity, requested_groups

EDGE = "struct<source_id:string,source_label:string,relation:string,target_id:string,target_label:string>"


def with_requests(questions: DataFrame) -> DataFrame:
    """questions (qid, root, relations, beam_width, max_depth) with what their relations ask for."""
    codes = F.array_distinct(F.array_compact(F.transform("relations", relation_codes)))
    return questions.withColumns({"groups": requested_groups(F.col("relations")), "canonical": F.transform("relations", canonical_relation), "codes": codes})


def requested_edges(asked: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges that any question may take: a filter at the scan, unless one asks for all relations. Codes are few."""
    codes = [r.code for r in asked.select(F.explode_outer(F.when(F.size("codes") > 0, F.col("codes"))).alias("code")).distinct().collect()]
    return edges if None in codes else edges.where(F.col("relation").isin(codes))


def numbered(asked: DataFrame, edges: DataFrame, similar: Mapping[tuple[str, str], float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(questions, allowed): with_requests() of questions with the number of what they ask for; and of each such request the
    relations of edges that its codes allow (all, if none), with their similarity, which takes long to find for every edge. asked: a step."""
    requests = step(asked.select("groups", "canonical", "codes").distinct().withColumn("request", F.monotonically_increasing_id()))
    allowed = requests.crossJoin(edges.select("relation").distinct()).where((F.size("codes") == 0) | F.array_contains("codes", F.col("relation")))
    allowed = allowed.select("request", "relation", relation_similarity(F.col("relation"), F.col("groups"), F.col("canonical"), similar).alias("similarity"))
    return step(asked.join(requests, ["groups", "canonical", "codes"]).drop("groups", "canonical", "codes")), step(allowed)


def neighbours(places: DataFrame, allowed: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 100) -> DataFrame:
    """(at, request, order, relation, next, similarity, next_label) of places (at, request; different rows, a step), with
    allowed of numbered(): the edges from either end, each once, of allowed relations, limit of a node, in order of relation
    and target; then those above RELATION_FLOOR, RELATION_KEPT of them, or where there is none the first RELATION_FALLBACK.
    That is found once for all beams that are at a node with one request."""
    ways = both_ways(edges).select(F.col("src").alias("at"), "relation", F.col("dst").alias("next"))
    found = among(ways, "at", places.select("at")).repartition("at").join(places.hint("shuffle_hash"), "at")
    of = F.broadcast(allowed.withColumnsRenamed({"request": "__request", "relation": "__relation"}))
    found = found.join(of, (F.col("request") == F.col("__request")) & F.col("relation").eqNullSafe(F.col("__relation"))).drop("__request", "__relation")
    found = nearest(found.select("at", "request", "relation", "next", "similarity"), ["at", "request"], ["relation", "next"], limit)
    place = Window.partitionBy("at", "request")
    passes = F.col("similarity") > V.RELATION_FLOOR
    found = found.withColumn("some", F.max(passes).over(place)).withColumn("place", F.row_number().over(place.orderBy(F.desc(passes), F.when(passes, -F.col("similarity")), "order")))
    found = step(found.where(F.when(F.col("some"), passes & (F.col("place") <= V.RELATION_KEPT)).otherwise(F.col("order") <= V.RELATION_FALLBACK)).drop("some", "place"))
    labels = among(nodes.select(F.col("id").alias("next"), F.col("label").alias("next_label")), "next", found.select("next"))
    return found.join(labels, "next")


def beam_search(
    questions: DataFrame, nodes: DataFrame, edges: DataFrame, floor: float = V.PATH_FLOOR, targets: DataFrame | None = None, similar: Mapping[tuple[str, str], float] | None = None
) -> DataFrame:
    """(qid, rank, depth, nodes, edges, score): every path that a question's beams held, the best first.

    At each depth a node is expanded for its first beam only; edges are chosen as in neighbours(); paths don't return to
    a node; scores under floor go; the width adapts to how the mean score compares with the best. A question ends
    when no path is left, its best is over STOP_SCORE, or the mean falls under STOP_DROP of the last depth's; the
    paths of that depth count. Ties go by the parent's rank, then relation and target. targets (qid, next, target) says
    how similar a path's last node is to what the question looks for, 0 where it has no row; similar does so for pairs
    of canonical relations. Each depth reads the edges, which may repeat, once, and moves only those at nodes it expands.
    """
    asked = step(with_requests(questions))
    edges, nodes = requested_edges(asked, edges), nodes.select("id", "label")
    asked, allowed = numbered(asked, edges, similar)
    labels = among(nodes.select(F.col("id").alias("root"), F.col("label").alias("at_label")), "root", asked.select("root"))
    beams = step(asked.join(labels, "root").select(
        "qid", "beam_width", "max_depth", "request", F.lit(1).alias("rank"), F.col("root").alias("at"), "at_label", F.array("root").alias("nodes"),
        F.array().cast(f"array<{EDGE}>").alias("edges"), F.array().cast("array<double>").alias("sims"), F.lit(None).cast("double").alias("last_mean"),
    ))
    deepest, out, depth = asked.agg(F.max("max_depth")).first()[0] or 0, None, 0
    while depth < deepest:
        depth += 1
        live = first_of(beams.where(F.col("max_depth") >= depth), ["qid", "at"], ["rank"], 1)
        places = step(live.select("at", "request").distinct())
        near = step(neighbours(places, allowed, nodes, edges))
        found = live.join(near, ["at", "request"]).where(~F.array_contains("nodes", F.col("next")))
        found = found.join(targets.select("qid", "next", "target"), ["qid", "next"], "left") if targets is not None else found.withColumn("target", F.lit(0.0))
        found = found.withColumn("score", path_score(F.concat("sims", F.array("similarity")), F.coalesce("target", F.lit(0.0)))).where(F.col("score") >= floor)
        # What ranks them is small; the paths that stay get their nodes and edges after.
        found = found.select("qid", F.col("rank").alias("parent"), "beam_width", "order", "relation", "next", "next_label", "similarity", "score")
        own = Window.partitionBy("qid")
        ranked = found.withColumn("rank", F.row_number().over(own.orderBy(F.desc("score"), "parent", "order")))
        ranked = ranked.withColumns({"mean": F.round(F.avg("score").over(own), 9), "most": F.max("score").over(own)})
        kept = ranked.where(F.col("rank") <= adaptive_width(F.col("beam_width"), F.col("mean"), F.col("most"))).drop("beam_width")
        kept = kept.join(live.withColumnRenamed("rank", "parent"), ["qid", "parent"])
        edge = F.struct(F.col("at").alias("source_id"), F.col("at_label").alias("source_label"), "relation", F.col("next").alias("target_id"), F.col("next_label").alias("target_label"))
        kept = step(kept.withColumns({"sims": F.concat("sims", F.array("similarity")), "edges": F.concat("edges", F.array(edge)), "nodes": F.concat("nodes", F.array("next"))}))
        rows = kept.select("qid", F.lit(depth).alias("depth"), "rank", "nodes", "edges", "score")
        out = rows if out is None else out.unionByName(rows)
        if kept.isEmpty():
            break
        fell = F.col("last_mean").isNotNull() & (F.col("mean") < F.round(V.STOP_DROP * F.col("last_mean"), 9))
        beams = kept.where((F.col("most") <= V.STOP_SCORE) & ~fell).select(
            "qid", "beam_width", "max_depth", "request", "rank", F.col("next").alias("at"), F.col("next_label").alias("at_label"), "nodes", "edges", "sims", F.col("mean").alias("last_mean")
        )
    final = Window.partitionBy("qid").orderBy(F.desc("score"), "depth", "place")
    return out.withColumnRenamed("rank", "place").withColumn("rank", F.row_number().over(final)).select("qid", "rank", "depth", "nodes", "edges", "score")


def diverse(paths: DataFrame) -> DataFrame:
    """The best path of each sequence of relations."""
    rows = paths.withColumn("relations", F.transform("edges", lambda e: e.relation))
    return first_of(rows, ["qid", "relations"], [F.desc("score"), "rank"], 1)
