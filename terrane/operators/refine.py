"""Refinement: duplicate nodes, time nodes, links, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import vocabulary as V
from ..functions.ontology import year_node
from ..functions.text import norm_lower_ws
from ..plans.steps import marked, step


def keyed(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("key", norm_lower_ws("label")).withColumn("block", F.substring("key", 1, 1))


def length_band(key: str, least: float):
    """Bands of lengths, each by a factor beyond which no ratio of least is possible; near lengths are in the same or next."""
    factor = (2 * 100 / least - 1) * 1.000001
    return F.floor(F.log(F.greatest(F.length(key), F.lit(1))) / F.log(F.lit(factor))).cast("int")


def similar_labels(a: DataFrame, blocks: list[str], ratio, least: float) -> DataFrame:
    """Pairs (key_a, key_b, value) of different keys of a (blocks, key), in one block, with a ratio of least or more.

    Equal keys are one row. Keys meet only those in their block and their own or a neighbouring band of lengths.
    """
    rows = a.select(*blocks, "key").distinct().withColumn("band", length_band("key", least))
    left = rows.select(*blocks, F.col("key").alias("key_a"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    right = rows.withColumnRenamed("key", "key_b")
    near = left.join(right, [*blocks, "band"]).where(F.col("key_a") < F.col("key_b")).where(S.possible(F.col("key_a"), F.col("key_b"), least))
    return near.withColumn("value", ratio(F.col("key_a"), F.col("key_b"))).where(F.col("value") >= least).select(*blocks, "key_a", "key_b", "value")


def same_entity_pairs(nodes: DataFrame, least: float = V.DEDUP_RATIO) -> DataFrame:
    """Pairs (a, b) of node ids, a before b by ord, that are the same entity: equal type and ner_type, first letter, and
    equal or similar normal labels. nodes: (id, ord, label, type, ner_type)."""
    rows = keyed(nodes).select("id", "ord", "type", "ner_type", "block", "key")
    blocks = ["type", "ner_type", "block"]
    similar = similar_labels(rows, blocks, S.token_sort_ratio, least).select(*blocks, "key_a", "key_b")
    both = similar.unionByName(similar.select(*blocks, F.col("key_b").alias("key_a"), F.col("key_a").alias("key_b")))
    every = both.unionByName(rows.select(*blocks, F.col("key").alias("key_a"), F.col("key").alias("key_b")).distinct())
    a = rows.select(*blocks, F.col("key").alias("key_a"), F.col("id").alias("a"), F.col("ord").alias("ord_a"))
    b = rows.select(*blocks, F.col("key").alias("key_b"), F.col("id").alias("b"), F.col("ord").alias("ord_b"))
    return a.join(every, [*blocks, "key_a"]).join(b, [*blocks, "key_b"]).where("ord_a < ord_b").select("a", "ord_a", "b", "ord_b")


def resolve(nodes: DataFrame, least: float = V.DEDUP_RATIO) -> DataFrame:
    """(dropped, kept): each node that an earlier kept node matches, and the first such.

    Every node in order is kept unless one kept before it matches it; matches aren't transitive. In rounds: a node
    whose earlier matches are all decided is decided, too. So nothing needs a whole block in one task.
    """
    pairs = step(same_entity_pairs(nodes, least))
    undecided = pairs.select(F.col("b").alias("id")).distinct()
    dropped = None
    kept = pairs.select(F.col("a").alias("id")).distinct().join(undecided, "id", "left_anti")
    while True:
        # Nodes that a kept node matches go to the first such; those whose other earlier matches are gone are kept.
        hit = pairs.join(kept.withColumnRenamed("id", "a"), "a", "left_semi").join(undecided.withColumnRenamed("id", "b"), "b", "left_semi")
        waits = pairs.join(undecided.withColumnRenamed("id", "a"), "a", "left_semi").select("b", F.col("ord_a").alias("open"))
        first = hit.groupBy("b").agg(F.min(F.struct("ord_a", "a")).alias("first"))
        least_open = waits.groupBy("b").agg(F.min("open").alias("open"))
        state = undecided.withColumnRenamed("id", "b").join(first, "b", "left").join(least_open, "b", "left")
        state = step(state.select("b", "first", "open"))
        gone = state.where("first is not null and (open is null or open > first.ord_a)").select(F.col("b").alias("dropped"), F.col("first.a").alias("kept"))
        free = state.where("first is null and open is null").select(F.col("b").alias("id"))
        dropped = gone if dropped is None else dropped.unionByName(gone)
        kept = kept.unionByName(free)
        undecided = step(undecided.join(gone.select(F.col("dropped").alias("id")), "id", "left_anti").join(free, "id", "left_anti"))
        if undecided.isEmpty():
            return dropped


def merge_nodes(nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Kept nodes: empty coordinates, inception and address come from the first dropped node that has them, labels of
    dropped nodes become aliases, linked properties are united by id. nodes: with ord."""
    rows = nodes.join(aliases.withColumnRenamed("dropped", "id"), "id", "left").withColumn("__of", F.coalesce("kept", "id"))
    first = lambda c, ok: F.min_by(F.col(c), F.when(ok, F.struct(F.col("kept").isNotNull(), F.col("ord"))))
    own = F.min_by(F.struct(*[c for c in nodes.columns if c not in ("latitude", "longitude", "inception", "address", "aliases", "id", "wd_properties")]), F.struct(F.col("kept").isNotNull(), F.col("ord")))
    sums = [first(c, F.col(c).isNotNull()).alias(c) for c in ("latitude", "longitude")]
    sums += [first(c, F.col(c).isNotNull() & (F.col(c) != "")).alias(c) for c in ("inception", "address")]
    merged = rows.groupBy(F.col("__of").alias("id")).agg(
        own.alias("__own"), *sums, F.array_sort(F.collect_set(F.when(F.col("kept").isNotNull(), F.col("label")))).alias("aliases"), *(_linked(rows) if "wd_properties" in nodes.columns else [])
    )
    return merged.select("id", "__own.*", *[c for c in merged.columns if c not in ("id", "__own")])


def _united(rows: DataFrame, name: str):
    """A linked property's values of all members, the kept node's first, one for each id."""
    members = F.array_sort(F.collect_list(F.struct(F.col("kept").isNotNull().alias("k"), F.col("ord").alias("o"), F.col(f"wd_properties.{name}").alias("v"))))
    listed = F.flatten(F.transform(members, lambda s: s.v))
    ids = F.array_distinct(F.transform(listed, lambda x: x.id))
    return F.transform(ids, lambda i: F.element_at(F.filter(listed, lambda x: x.id.eqNullSafe(i)), 1)).alias(name)


def _linked(rows: DataFrame) -> list:
    return [_united(rows, name) for name in ("instance_of", "heritage_designation", "country")]


def remap_relations(relations: DataFrame, aliases: DataFrame) -> DataFrame:
    """Relations with kept ends, without loops, distinct. Those without a dropped end don't travel to be looked up; equal
    ones meet by a sort, whose memory is bounded."""
    aliases = step(aliases.select("dropped", "kept"))
    end = lambda c: aliases.select(F.col("dropped").alias(c), F.col("kept").alias(f"{c}_kept"))
    rows = relations.select("source", "relation", "target")
    for c in ("source", "target"):
        rows = marked(rows, c, aliases.select("dropped"), f"{c}_may")
    moved = rows.where("source_may or target_may").join(end("source"), "source", "left").join(end("target"), "target", "left")
    moved = moved.select(F.coalesce("source_kept", "source").alias("source"), "relation", F.coalesce("target_kept", "target").alias("target"))
    rows = rows.where("not (source_may or target_may)").select("source", "relation", "target").unionByName(moved).where("source != target")
    return once(rows)


def once(rows: DataFrame) -> DataFrame:
    """Different rows: each goes to its place as it is, and a sort brings equal ones together. Hash tables of rows that
    hardly repeat would cost several times the memory, before the shuffle and after it."""
    own = rows.columns
    w = Window.partitionBy(*own).orderBy(F.lit(1))
    return rows.repartition(*own).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def temporal_edges(nodes: DataFrame) -> DataFrame:
    return nodes.where("inception is not null and inception != ''").select(F.col("id").alias("source"), F.lit("P4_has_time_span").alias("relation"), year_node(F.col("inception")).alias("target"))


def temporal_nodes(nodes: DataFrame) -> DataFrame:
    """Year nodes that nodes don't have yet."""
    years = temporal_edges(nodes).select(F.col("target").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    return years.select("id", F.substring("id", 6, 4).alias("label"), F.lit("E52_Time_Span").alias("type"))


def cross_links(nodes: DataFrame, least: float = V.LINKAGE_RATIO) -> DataFrame:
    """Links (source, target, relation, confidence) between nodes of one first letter whose normal labels are similar."""
    rows = keyed(nodes).select("id", "ord", "block", "key").where("key != ''")
    similar = similar_labels(rows, ["block"], S.ratio, least)
    both = similar.unionByName(similar.select("block", F.col("key_b").alias("key_a"), F.col("key_a").alias("key_b"), "value"))
    every = both.unionByName(rows.select("block", F.col("key").alias("key_a"), F.col("key").alias("key_b"), F.lit(100.0).alias("value")).distinct())
    a = rows.select("block", F.col("key").alias("key_a"), F.col("id").alias("source"), F.col("ord").alias("oa"))
    b = rows.select("block", F.col("key").alias("key_b"), F.col("id").alias("target"), F.col("ord").alias("ob"))
    linked = a.join(every, ["block", "key_a"]).join(b, ["block", "key_b"]).where("oa < ob and source != target")
    return linked.select("source", "target", F.lit("related_to").alias("relation"), F.round("value", 2).alias("confidence"))


def words(text: str):
    return F.array_distinct(F.filter(F.split(F.col(text), r"(?U)[^\w]+"), lambda w: w != ""))


def provenance(nodes: DataFrame, chunks: DataFrame, most_labels: int = 100_000) -> DataFrame:
    """(entity_id, chunk_id, source) where a normal label of two letters or more is in a chunk as whole words.

    A label's longest word must be a word of the chunk. Up to most_labels labels are sent to the chunks, whose texts so
    stay where they are and are brought to their normal form once. More labels meet the chunks' words in a join without
    texts; each chunk's text then meets its candidates once. The whole labels are searched. Chunks with equal ids are one
    row of candidates each.
    """
    labels = nodes.select(F.col("id").alias("entity_id"), norm_lower_ws("label").alias("label")).where(F.length("label") >= 2)
    longest = F.reduce(words("label"), F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))
    labels = step(labels.withColumn("word", longest).where("word != ''"))
    few = labels.count() <= most_labels
    labels = labels.groupBy("word").agg(F.collect_list(F.struct("entity_id", "label")).alias("own"))
    texts = chunks.select("chunk_id", "source", norm_lower_ws("text").alias("text"))
    quoted = lambda label: F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(label, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?!\w)"))
    held = F.filter("own", lambda x: F.when(F.contains("text", x.label), F.rlike("text", quoted(x.label))).otherwise(F.lit(False)))
    if few:
        candidates = texts.withColumn("word", F.explode(words("text"))).join(F.broadcast(labels), "word")
    else:
        at = texts.select("chunk_id", F.explode(words("text")).alias("word")).distinct().join(labels, "word")
        candidates = texts.join(at.groupBy("chunk_id").agg(F.flatten(F.collect_list("own")).alias("own")), "chunk_id")
    found = candidates.select("chunk_id", "source", F.explode(F.transform(held, lambda x: x.entity_id)).alias("entity_id"))
    return found.select("entity_id", "chunk_id", "source").distinct()
