"""Mappings between relations, classes and types as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .text import first_keyword


def lookup(c: Column, table: dict[str, str], default: Column | str | None = None) -> Column:
    """A literal map's value; a CASE over few keys stays in generated code."""
    out = default if isinstance(default, Column) else F.lit(default)
    for key, value in reversed(list(table.items())):
        out = F.when(c == key, value).otherwise(out)
    return out


def property_relation(code: Column) -> Column:
    return lookup(code, V.PROPERTY_RELATIONS)


def map_relation(relation: Column, code: Column, label: Column) -> Column:
    """A stored relation's code: by its name, else its property, else the property's label; related_to if unknown."""
    return lookup(F.coalesce(*(F.nullif(c, F.lit("")) for c in (relation, code, label))), V.CIDOC_RELATIONS, "related_to")


def cidoc_class(label: Column) -> Column:
    return lookup(F.upper(F.trim(label)), V.CIDOC_CLASSES, V.DEFAULT_CIDOC_CLASS)


def cidoc_relation(name: Column) -> Column:
    return lookup(F.lower(F.trim(name)), V.CIDOC_RELATIONS, V.DEFAULT_CIDOC_RELATION)


def internal_relation(code: Column) -> Column:
    """The name of a code, whatever its case; others in lower case."""
    low = F.lower(code)
    return lookup(low, {v.lower(): k for k, v in V.CIDOC_RELATIONS.items()}, low)


def canonical_relation(name: Column) -> Column:
    return first_keyword(F.lower(F.trim(F.coalesce(name, F.lit("")))), V.CANONICAL_KEYWORDS, "related_to")


def relation_codes(name: Column) -> Column:
    """A requested relation's code: of its own name, else of the first name that it contains; null is no filter."""
    low = F.lower(F.trim(name))
    inside = F.lit(None).cast("string")
    for key, value in reversed(list(V.CIDOC_RELATIONS.items())):
        inside = F.when(F.contains(low, F.lit(key)), value).otherwise(inside)
    return F.coalesce(lookup(low, V.CIDOC_RELATIONS), inside)


def safe_relation(name: Column) -> Column:
    """A relation type's name: hyphens, blanks and dots as underscores."""
    return F.coalesce(F.nullif(F.regexp_replace(name, r"[- .]", "_"), F.lit("")), F.lit("RELATED_TO"))


def node_type(classes: Column, designated: Column, located: Column, ner: Column) -> Column:
    """FAC for designated or located things, else by the words of their classes, else the tagger's type."""
    joined = F.lower(F.array_join(classes, " "))
    return F.when(designated | located, "FAC").otherwise(first_keyword(joined, V.NODE_KEYWORDS, ner))


def ontology_type(text: Column) -> Column:
    return first_keyword(F.lower(text), V.ONTOLOGY_KEYWORDS, None)


def resolved_type(designated: Column, classes: Column, located: Column, ner: Column) -> Column:
    return F.when(designated, "HISTORICAL_RELICT").otherwise(F.coalesce(ontology_type(F.array_join(classes, " ")), F.when(located, "LOC"), F.nullif(ner, F.lit("")), F.lit("UNKNOWN")))


def year_node(inception: Column) -> Column:
    """YEAR_yyyy of a time such as +1955-00-00T00:00:00Z."""
    return F.concat(F.lit("YEAR_"), F.substring(inception, 2, 4))


def heritage_type(label: Column, kind: Column) -> Column:
    """A tagger's type; a location with a relict's word in its name is a relict."""
    relict = F.rlike(label, F.lit(r"(?iU)\b(" + "|".join(V.RELICT_WORDS) + r")\b"))
    return F.when((kind == "LOC") & relict, "HISTORICAL_RELICT").otherwise(kind)
