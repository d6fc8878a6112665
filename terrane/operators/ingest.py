"""From claims and records to nodes, relations and triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ontology as O
from ..functions import vocabulary as V


def latest(rows: DataFrame, keys: list[str], order: str, last: bool = True) -> DataFrame:
    """Of the rows with equal keys, the last (or first) by order, by an aggregate that combines before its shuffle.
    Rows with a null or empty key go."""
    for k in keys:
        rows = rows.where(F.col(k).isNotNull() & (F.col(k).cast("string") != ""))
    rest = [c for c in rows.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return rows.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("__row")).select(*keys, "__row.*").select(rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """old with new's rows in place of those with equal keys. Of new's rows with equal keys the last by order counts
    (any one where there is none). Rows without a key go."""
    o = F.col(order) if order else F.lit(0)
    both = old.select("*", F.struct(F.lit(0), o.alias("o")).alias("__at")).unionByName(new.select("*", F.struct(F.lit(1), o.alias("o")).alias("__at")))
    return latest(both, keys, "__at").drop("__at")


def merge_properties(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Property merge: new values that aren't null replace old ones, others stay."""
    columns = [c for c in old.columns if c != key]
    joined = old.alias("o").join(new.alias("n"), key, "full_outer")
    return joined.select(key, *[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in columns])


def claim_split(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Claims (entity_id, property, datatype, value JSON) as relations (source, property, target, relation), and as
    metadata (entity_id, property, target JSON) of the kept properties."""
    relations = claims.where(F.col("property").isin(list(V.PROPERTY_RELATIONS))).select(
        F.col("entity_id").alias("source"), "property", F.get_json_object("value", "$.id").alias("target"), O.property_relation(F.col("property")).alias("relation")
    )
    place = F.to_json(F.struct(F.get_json_object("value", "$.latitude").cast("double").alias("latitude"), F.get_json_object("value", "$.longitude").cast("double").alias("longitude")))
    item = F.to_json(F.struct(F.get_json_object("value", "$.id").alias("id"), F.get_json_object("value", "$.label").alias("label")))
    text = F.coalesce(F.get_json_object("value", "$.time"), F.get_json_object("value", "$.text"), F.col("value"))
    target = F.when(F.col("datatype") == "globe-coordinate", place).when(F.col("datatype") == "wikibase-item", item).otherwise(text)
    metadata = claims.where(F.col("property").isin(V.METADATA_PROPERTIES)).select("entity_id", "property", target.alias("target"))
    return relations.where("target is not null"), metadata.where("target is not null")


def valid_metadata(metadata: DataFrame) -> DataFrame:
    return metadata.where("entity_id is not null and entity_id != '' and property is not null and property != '' and target is not null")


def metadata_lookup(metadata: DataFrame, order: str) -> DataFrame:
    """(entity_id, property, targets): an entity's few values of a property, in order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("target").alias("t")))), lambda x: x.t)
    return valid_metadata(metadata).groupBy("entity_id", "property").agg(listed.alias("targets"))


def first_metadata(metadata: DataFrame, order: str) -> DataFrame:
    return valid_metadata(metadata).groupBy("entity_id", "property").agg(F.min_by("target", order).alias("target"))


def build_nodes(entities: DataFrame, metadata: DataFrame, ner: Column | str = "UNKNOWN") -> DataFrame:
    """Nodes of entities (id, label, description) and metadata (entity_id, property, target variant, ord). ner: a
    tagger's type of each entity, as a column of entities, or one for all."""
    at = lambda p: F.when(F.col("property") == p, F.col("target"))
    link = lambda p: F.transform(F.array_sort(F.collect_list(F.when(F.col("property") == p, F.struct(F.col("ord"), F.struct(F.expr("try_variant_get(target, '$.id', 'string')").alias("id"), F.expr("try_variant_get(target, '$.label', 'string')").alias("label")).alias("x"))))), lambda s: s.x)
    first = lambda p: F.min_by(at(p), F.when(F.col("property") == p, F.col("ord")))
    per = metadata.groupBy(F.col("entity_id").alias("id")).agg(
        first("P625").alias("place"), first("P571").alias("since"), first("P6375").alias("at"), link("P31").alias("instance_of"), link("P1435").alias("heritage_designation"), link("P17").alias("country")
    )
    none = F.array().cast("array<struct<id:string,label:string>>")
    joined = entities.join(per, "id", "left").withColumns({c: F.coalesce(c, none) for c in ("instance_of", "heritage_designation", "country")})
    number = lambda k: F.expr(f"try_variant_get(place, '$.{k}', 'double')")
    kind = O.node_type(F.transform("instance_of", lambda x: x.label), F.size("heritage_designation") > 0, F.col("place").isNotNull(), ner if isinstance(ner, Column) else F.lit(ner))
    return joined.select(
        "id",
        "label",
        O.cidoc_class(kind).alias("type"),
        kind.alias("ner_type"),
        "description",
        number("latitude").alias("latitude"),
        number("longitude").alias("longitude"),
        F.expr("try_variant_get(since, '$', 'string')").alias("inception"),
        F.expr("try_variant_get(at, '$', 'string')").alias("address"),
        F.struct("instance_of", "heritage_designation", "country").alias("wd_properties"),
    )


def map_relations(relations: DataFrame) -> DataFrame:
    """(source, target, relation code, original_relation), ends not empty, distinct."""
    label = F.col("property_label") if "property_label" in relations.columns else F.lit(None).cast("string")
    key = F.coalesce(*(F.nullif(c, F.lit("")) for c in (F.col("relation"), F.col("property"), label)))
    code = O.map_relation(F.col("relation"), F.col("property"), label)
    return relations.where("source != '' and target != ''").select("source", "target", code.alias("relation"), key.alias("original_relation")).distinct()


def triples(relations: DataFrame) -> DataFrame:
    """(subject, predicate, object): without null ends, distinct, and only then null predicates become related_to."""
    rows = relations.select(F.col("source").alias("subject"), F.col("relation").alias("predicate"), F.col("target").alias("object"))
    return rows.dropna(subset=["subject", "object"]).dropDuplicates().fillna({"predicate": "related_to"})


def coordinate_audit(metadata: DataFrame, sample: int = 5) -> DataFrame:
    """(n_rows, n_entities, sample): how many coordinates there are, of how many entities, and the first few (entity_id,
    target) by entity and target."""
    places = metadata.where("property = 'P625'")
    first = places.orderBy("entity_id", "target").limit(sample).agg(F.array_sort(F.collect_list(F.struct("entity_id", "target"))).alias("sample"))
    return places.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("entity_id").alias("n_entities")).crossJoin(first)  # a row each


def alias_union(a: Column, b: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))), "|")


def pruned(c: Column, kind: str = "string") -> Column:
    """A property without empty values: null for "", and for arrays and maps (kind as in dtypes) that hold nothing."""
    if kind.startswith(("array", "map")):
        return F.when(F.size(c) > 0, c)
    return F.nullif(c, F.lit("")) if kind == "string" else c


def prune_properties(nodes: DataFrame) -> DataFrame:
    return nodes.select(*[pruned(F.col(c), kind).alias(c) for c, kind in nodes.dtypes])


def flattened(c: str, fields: list[str]) -> list[Column]:
    """An array of structs as parallel arrays c_field."""
    of = lambda f: F.transform(c, lambda x: x[f])
    return [of(f).alias(f"{c}_{f}") for f in fields]


def entity_info(entities: DataFrame) -> DataFrame:
    """(id, label, description, aliases) of entities with label_vi, label_en, description_vi, description_en and
    aliases_vi: Vietnamese, else English, else empty; Vietnamese aliases only."""
    either = lambda c: F.coalesce(F.nullif(F.col(f"{c}_vi"), F.lit("")), F.nullif(F.col(f"{c}_en"), F.lit("")), F.lit("")).alias(c)
    return entities.select("id", either("label"), either("description"), F.coalesce("aliases_vi", F.array().cast("array<string>")).alias("aliases"))


def resolve_labels(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """claims (target, ...) with target_label: that of the entity fetched before (label_vi, else label_en), null where
    none was or it has neither."""
    label = F.coalesce(F.nullif(F.col("label_vi"), F.lit("")), F.nullif(F.col("label_en"), F.lit("")))
    return claims.join(entities.select(F.col("id").alias("target"), label.alias("target_label")), "target", "left")


def canonical_json(text: Column) -> Column:
    """One form for equal JSON objects, as a key to compare them by: sorted names, no blanks. Null if it isn't JSON."""
    return F.to_json(F.try_parse_json(text))
