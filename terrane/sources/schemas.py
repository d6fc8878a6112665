"""Schemas of the heritage graph's files."""

from pyspark.sql import types as T

SEEDS = "input_name string, wikidata_id string, canonical_name string, aliases string"
ENTITIES = "id string, label string, description string, aliases array<string>"
RELATIONS = "source string, property string, target string, relation string"
METADATA = "entity_id string, property string, target variant"
LINKED = "array<struct<id:string,label:string>>"
NODES = (
    "id string, label string, type string, ner_type string, description string, latitude double, longitude double, inception string, address string, "
    f"wd_properties struct<instance_of:{LINKED},heritage_designation:{LINKED},country:{LINKED}>, source string, download_date string, aliases array<string>"
)
MAPPED_RELATIONS = "source string, target string, relation string, original_relation string"
REFINED_RELATIONS = "source string, target string, relation string, confidence double"
CHUNKS = "chunk_id string, monument string, section string, text string, source string"
PROVENANCE = "entity_id string, chunk_id string, source string"
EDGE = T.StructType([T.StructField(n, T.StringType()) for n in ("source_id", "source_label", "relation", "target_id", "target_label")])
