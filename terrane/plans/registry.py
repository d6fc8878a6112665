"""Registered queries and, where SQL can express them, the same for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Pieces of SQL.


def squote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def contains_any(c: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({c}, {squote(w)})" for w in words) + ")"


def first_keyword(c: str, groups, default: str) -> str:
    return "case " + " ".join(f"when {contains_any(c, words)} then {squote(name)}" for name, words in groups) + f" else {default} end"


def lookup(c: str, table_: dict[str, str], default: str) -> str:
    return f"case {c} " + " ".join(f"when {squote(k)} then {squote(v)}" for k, v in table_.items()) + f" else {default} end"


def collapse(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def norm_lower(c: str) -> str:
    return collapse(f"lower(coalesce({c}, ''))")


def norm_link(c: str) -> str:
    return collapse(rf"regexp_replace(regexp_replace(strip_accents(lower({c})), '[-_/]', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g')")


def norm_legacy(c: str) -> str:
    return collapse(rf"regexp_replace(regexp_replace(strip_accents(lower({c})), '[-_/]', ' ', 'g'), '[^a-z0-9\s]', ' ', 'g')")


NODES = """
nodes as (select 'R' || r_regionkey as id, r_name as label, 'E53_Place' as type from region union all
  select 'N' || n_nationkey, n_name, 'E53_Place' from nation union all select 'S' || s_suppkey, s_name, 'E74_Group' from supplier union all
  select 'C' || c_custkey, c_name, 'E21_Person' from customer union all select 'P' || p_partkey, p_name, 'E22_Human-Made_Object' from part union all
  select 'O' || o_orderkey, 'Order ' || o_orderkey, 'E5_Event' from orders union all
  select distinct 'YEAR_' || year(o_orderdate), year(o_orderdate)::varchar, 'E52_Time_Span' from orders)"""
EDGES = """
edges as (select 'N' || n_nationkey as source, 'P53_has_former_or_current_location' as relation, 'R' || n_regionkey as target from nation union all
  select 'S' || s_suppkey, 'P53_has_former_or_current_location', 'N' || s_nationkey from supplier union all
  select 'C' || c_custkey, 'P53_has_former_or_current_location', 'N' || c_nationkey from customer union all
  select 'O' || o_orderkey, 'P14_carried_out_by', 'C' || o_custkey from orders union all
  select distinct 'P' || l_partkey, 'P108_was_produced_by', 'S' || l_suppkey from lineitem union all
  select distinct 'O' || l_orderkey, 'P46_is_composed_of', 'P' || l_partkey from lineitem union all
  select 'O' || o_orderkey, 'P4_has_time_span', 'YEAR_' || year(o_orderdate) from orders)"""
WAYS = "ways as (select source as src, relation, target as dst, true as forward from edges union all select target, relation, source, false from edges)"
#: Common subsequences of pairs (a, b), bits for the letters of a.
LCS = """
    step as (select a, b, 0 as j, (1::hugeint << length(a)) - 1 as v from pairs union all
      select a, b, j + 1, ((v + u) | (v - u)) & ((1::hugeint << length(a)) - 1) from
        (select a, b, j, v, v & list_sum(list_transform(range(length(a)), lambda i: case when substr(a, i::int + 1, 1) = substr(b, j + 1, 1) then 1::hugeint << i::int else 0::hugeint end))::hugeint as u from step where j < length(b))),
    lcs as (select a, b, length(a) - bit_count(v) as n from step where j = length(b))"""
