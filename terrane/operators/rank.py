"""Scores of paths. An edge is a struct with source_id, source_label, relation, target_id and target_label."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.ontology import canonical_relation, internal_relation


def requested_groups(relations: Column) -> Column:
    """The alias groups that requested relations name or mention."""

    def groups(name: Column) -> Column:
        low = F.lower(F.trim(name))
        hit = lambda key, aliases: F.when((low == key) | F.exists(F.array(*map(F.lit, aliases)), lambda a: F.contains(low, a)), F.lit(key))
        return F.array_compact(F.array(*[hit(k, a) for k, a in V.RELATION_ALIASES.items()]))

    return F.array_distinct(F.flatten(F.transform(relations, groups)))


def relation_similarity(relation: Column, groups: Column, canonical: Column, similar: Mapping[tuple[str, str], float] | None = None) -> Column:
    """Of an edge's relation and the requested ones (their alias groups and canonical names). Canonical names that
    differ have the similarity that `similar` gives for the two, such as an embedding model's cosine; 0 without one."""
    name = internal_relation(F.trim(relation))
    own = canonical_relation(name)
    other = F.lit(0.0)
    for (a, b), value in (similar or {}).items():
        other = F.greatest(other, F.when((own == a) & F.array_contains(canonical, b), float(value)).otherwise(0.0))
    return (
        F.when(F.array_contains(groups, name), 1.0)
        .when(F.array_contains(groups, F.lit("material_used")), V.MATERIAL_SIMILARITY)
        .when(F.array_contains(canonical, own), 1.0)
        .otherwise(other)
    )


def relation_score(similarities: Column) -> Column:
    """The mean of each edge's similarity divided by its place."""
    n = F.size(similarities)
    total = F.aggregate(F.transform(similarities, lambda s, i: s / (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return F.when(n > 0, total / F.greatest(n, F.lit(1))).otherwise(0.0)


def structure_score(n_edges: Column) -> Column:
    return F.when(n_edges > 0, F.greatest(F.lit(0.0), 1.0 - (n_edges - 1) * V.LENGTH_PENALTY)).otherwise(0.0)


def path_score(similarities: Column, target: Column | float = 0.0) -> Column:
    target = target if isinstance(target, Column) else F.lit(target)
    total = V.RELATION_WEIGHT * relation_score(similarities) + V.STRUCTURE_WEIGHT * structure_score(F.size(similarities)) + V.TARGET_WEIGHT * target
    return F.round(total, 4)


def adaptive_width(width: Column, mean: Column, most: Column) -> Column:
    """Rounded first, so that the order in which a mean's parts are added can't decide."""
    return F.greatest(F.lit(V.LEAST_BEAM), F.floor(F.round(width * mean / F.greatest(most, F.lit(0.1)), 9))).cast("int")
