"""The queries of the graph's operators, over the star schema and its documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ontology as O
from ..functions import similarity as S
from ..functions import text as X
from ..functions import vocabulary as V
from ..operators import beam, graph, ingest, qa, rank, refine
from ..sources import files, schemas
from ..streaming import upserts
from . import answers_sql as A
from . import registry as R
from .registry import QUERIES, SQL, query, table
from .steps import fresh_folder, step

__all__ = ["QUERIES", "SQL"]

# Text


def _normal(name: str, form, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "documents").select("doc_id", form("text").alias("norm"))

    run.__name__ = name
    query(f"select doc_id, {sql} as norm from documents")(run)


_normal("norm_ws", X.norm_ws, R.collapse("text"))
_normal("norm_lower_ws", X.norm_lower_ws, R.norm_lower("text"))
_normal("norm_link", X.norm_link, R.norm_link("text"))
_normal("norm_legacy", X.norm_legacy, R.norm_legacy("text"))
_normal("norm_cypher", X.norm_cypher, "translate(lower(text), '-_/', '   ')")
_normal("strip_citations", lambda c: X.strip_citations(F.concat(F.lit("[12]"), F.col(c), F.lit(" [a] [cần dẫn nguồn]"))), R.collapse(f"regexp_replace('[12]' || text || ' [a] [cần dẫn nguồn]', {R.squote(V.CITATION)}, '', 'g')"))


CHUNK_STEPS = """with recursive c as (
      select doc_id, text, length(text) as n, 0 as start, 0 as k from documents where length(trim(text)) > 0),
    w as (select doc_id, text, n, k, start, case when start + 800 >= n then n else
            coalesce(nullif(start + 800 - coalesce(nullif(strpos(translate(reverse(substr(text, start + 1, 800)), chr(10) || '.,!?', '     '), ' '), 0), 801) + 1, start), start + 800) end as fin from c
      union all
      select doc_id, text, n, k, s as start, case when s + 800 >= n then n else
            coalesce(nullif(s + 800 - coalesce(nullif(strpos(translate(reverse(substr(text, s + 1, 800)), chr(10) || '.,!?', '     '), ' '), 0), 801) + 1, s), s + 800) end
      from (select doc_id, text, n, k + 1 as k, start + greatest(1, fin - start - 100) as s from w where fin < n))"""


@query(rf"""{CHUNK_STEPS}, t as (select *, regexp_replace(substr(text, start + 1, fin - start), '^\s+|\s+$', '', 'g') as part from w)
    select doc_id, sha256(concat_ws('|', doc_id, '{V.DEFAULT_CHUNK_SECTION}', k)) as chunk_id, k::bigint as ordinal, start::bigint as start, length(part) as n_chars, '{V.DEFAULT_CHUNK_SECTION}' as section, part as text from t""")
def chunk_offsets(spark, sf_dir):
    return X.chunks(table(spark, sf_dir, "documents"))


@query(
    r"""with recursive c as (
      select doc_id, text, length(text) as n, 0 as start, case when length(text) <= 800 then length(text) else null end as fin from documents where length(trim(text)) > 0),
    w as (select doc_id, text, n, start, case when start + 800 >= n then n else
            coalesce(nullif(start + 800 - coalesce(nullif(strpos(translate(reverse(substr(text, start + 1, 800)), chr(10) || '.,!?', '     '), ' '), 0), 801) + 1, start), start + 800) end as fin from c
      union all
      select doc_id, text, n, s as start, case when s + 800 >= n then n else
            coalesce(nullif(s + 800 - coalesce(nullif(strpos(translate(reverse(substr(text, s + 1, 800)), chr(10) || '.,!?', '     '), ' '), 0), 801) + 1, s), s + 800) end
      from (select doc_id, text, n, start + greatest(1, fin - start - 100) as s from w where fin < n))
    select doc_id, count(*) as n_chunks, sum(start)::bigint as starts from w group by doc_id"""
)
def chunk_stats(spark, sf_dir):
    return X.chunks(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("start").alias("starts"))


def _cleared(html: str) -> str:
    """Html without comments, removed tags and removed classes of the usual elements."""
    out = f"regexp_replace({html}, '<!--.*?-->', '', 'gs')"
    for tag in V.REMOVED_TAGS:
        out = rf"regexp_replace({out}, '<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'gis')"
    for name in V.REMOVED_CLASSES:
        for tag in ("div", "table", "span", "sup", "ul", "ol", "section"):
            out = rf"""regexp_replace({out}, '<{tag}\b[^>]*\bclass\s*=\s*["''](?:[^"'']*\s)?{name}(?:\s[^"'']*)?["''][^>]*>.*?</{tag}\s*>', '', 'gis')"""
    return out


def _plain(html: str) -> str:
    out = f"regexp_replace({html}, '<[^>]*>', '', 'g')"
    for entity, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{letter}')"
    return R.collapse(f"regexp_replace({out}, {R.squote(V.CITATION)}, '', 'g')")


CLEARED = f"cleared as (select page_id, {_cleared('html')} as html from pages)"


@query(rf"""with {CLEARED}, p as (select page_id, unnest(regexp_extract_all(html, '<p\b[^>]*>(.*?)</p\s*>', 1, 'is')) as raw, generate_subscripts(regexp_extract_all(html, '<p\b[^>]*>(.*?)</p\s*>', 1, 'is'), 1) - 1 as ordinal from cleared)
    select page_id, ordinal::bigint as ordinal, {_plain('raw')} as text from p where length({_plain('raw')}) > {V.LEAST_PARAGRAPH}""")
def page_paragraphs(spark, sf_dir):
    return X.page_paragraphs(table(spark, sf_dir, "pages"))


BLOCK = r"'(<(?:h2|h3|p)\b[^>]*>.*?</(?:h2|h3|p)\s*>)', 1, 'is'"


@query(rf"""with {CLEARED}, b as (select page_id, unnest(regexp_extract_all(html, {BLOCK})) as raw, generate_subscripts(regexp_extract_all(html, {BLOCK}), 1) as i from cleared),
    t as (select page_id, i, {_plain('raw')} as text, regexp_matches(raw, '^<h[23]', 'i') as heading from b), n as (select *, sum(heading::int) over (partition by page_id order by i) as n from t),
    h as (select page_id, n, any_value(text) as section from n where heading group by all),
    w as (select n.page_id, n.n, coalesce(h.section, '{V.DEFAULT_SECTION}') as section, string_agg(text, ' ' order by i) as text from n left join h on h.page_id = n.page_id and h.n = n.n where not heading and length(text) > {V.LEAST_PARAGRAPH} group by all)
    select page_id, n::bigint as ordinal, section, text from w where length(text) > {V.LEAST_SECTION} and section not in ({', '.join(map(R.squote, V.IGNORED_SECTIONS))})""")
def page_sections(spark, sf_dir):
    return X.page_sections(table(spark, sf_dir, "pages"))


def tagged(spark, sf_dir):
    """Documents' words as tokens with tags that their lengths give."""
    tokens = S.tokens(F.col("text"))
    tags = F.transform(tokens, lambda w: F.when(F.length(w) % 4 == 1, "B-LOC").when(F.length(w) % 4 == 2, "I-LOC").when(F.length(w) % 4 == 3, "I-PER").otherwise("O"))
    return table(spark, sf_dir, "documents").select("doc_id", tokens.alias("tokens"), tags.alias("tags"))


@query(
    r"""with t as (select doc_id, unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x != '')) as w, generate_subscripts(list_filter(string_split_regex(text, '\s+'), lambda x: x != ''), 1) as i from documents),
    g as (select *, case length(w) % 4 when 1 then 'B' when 2 then 'I' when 3 then 'I' else 'O' end as m, case length(w) % 4 when 1 then 'LOC' when 2 then 'LOC' when 3 then 'PER' else '' end as l from t),
    h as (select *, lag(m) over (partition by doc_id order by i) as pm, lag(l) over (partition by doc_id order by i) as pl from g),
    s as (select *, sum(case when m = 'B' or (m = 'I' and (pm is null or pm = 'O' or pl != l)) then 1 else 0 end) over (partition by doc_id order by i) as k from h where true)
    select doc_id, k::bigint as ordinal, any_value(l) as label, string_agg(w, ' ' order by i) as span from s where m != 'O' group by doc_id, k"""
)
def bio_spans(spark, sf_dir):
    rows = tagged(spark, sf_dir).select("doc_id", F.posexplode(X.bio_spans(F.col("tokens"), F.col("tags"))).alias("i", "s"))
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("ordinal"), F.col("s.label").alias("label"), F.col("s.text").alias("span"))


# Mapping


def sample_word():
    return F.element_at(F.array(*map(F.lit, SAMPLE_WORDS)), (F.col("p_partkey") % N_WORDS + 1).cast("int"))


def _words(sql_name: str, form, sql: str) -> None:
    """A function of the words that parts and events have."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_type", "p_name", sample_word()).alias("w"), "p_partkey")
        return rows.select("p_partkey", form(F.col("w")).alias("value"))

    run.__name__ = sql_name
    query(f"select p_partkey, {sql} as value from (select p_partkey, concat_ws(' ', p_type, p_name, {WORDS_SQL}[p_partkey % {N_WORDS} + 1]) as w from part)")(run)


SAMPLE_WORDS = ["kiến trúc sư của", "located_in", "built by", "xây dựng", "part of", "làm bằng", "P53", "temple", "river", "nhân vật", "steel", "công ty", "thành phố", "dynasty", "festival", "year", "chùa", "nothing", "kinh độ", "mô tả", "nước nào", "ở đâu", "material_used", "time_span", "P14_carried_out_by", "architect"]
N_WORDS = len(SAMPLE_WORDS)
WORDS_SQL = "[" + ", ".join(map(R.squote, SAMPLE_WORDS)) + "]"
LAST = "regexp_extract(w, '^[^ ]+ [^ ]+ [^ ]+ (.*)$', 1)"
last = lambda c: F.regexp_extract(c, "^[^ ]+ [^ ]+ [^ ]+ (.*)$", 1)

_words("canonical_relation", O.canonical_relation, R.first_keyword("lower(trim(w))", V.CANONICAL_KEYWORDS, "'related_to'"))
_words("ontology_typing", lambda c: F.coalesce(O.ontology_type(c), F.lit("none")), f"coalesce({R.first_keyword('lower(w)', V.ONTOLOGY_KEYWORDS, 'null')}, 'none')")
_words("question_relation", lambda c: F.coalesce(qa.asked_relation(c), F.lit("none")), f"coalesce({R.first_keyword('trim(lower(w))', V.QUESTION_KEYWORDS, 'null')}, 'none')")
_words("relation_inverse", lambda c: O.internal_relation(last(c)), R.lookup(f"lower({LAST})", {v.lower(): k for k, v in V.CIDOC_RELATIONS.items()}, f"lower({LAST})"))
_words("relation_types", lambda c: F.coalesce(O.relation_codes(last(c)), F.lit("all")), f"coalesce({R.lookup(f'lower(trim({LAST}))', V.CIDOC_RELATIONS, 'null')}, case " + " ".join(f"when contains(lower(trim({LAST})), '{k}') then '{v}'" for k, v in V.CIDOC_RELATIONS.items()) + " end, 'all')")
_words("safe_relation", O.safe_relation, "coalesce(nullif(regexp_replace(w, '[- .]', '_', 'g'), ''), 'RELATED_TO')")
_words("cidoc_relation", lambda c: O.cidoc_relation(last(c)), R.lookup(f"lower(trim({LAST}))", V.CIDOC_RELATIONS, f"'{V.DEFAULT_CIDOC_RELATION}'"))
_words("heritage_relabel", lambda c: O.heritage_type(c, F.lit("LOC")), rf"case when regexp_matches(' ' || lower(w) || ' ', '[^\p{{L}}\p{{N}}_](" + "|".join(V.RELICT_WORDS) + r")[^\p{L}\p{N}_]') then 'HISTORICAL_RELICT' else 'LOC' end")


@query(f"select p_partkey, case when p_size < 5 or p_size > 45 then 'FAC' else {R.first_keyword('lower(w)', V.NODE_KEYWORDS, repr('UNKNOWN'))} end as kind from (select *, concat_ws(' ', p_type, p_name, {WORDS_SQL}[p_partkey % {N_WORDS} + 1]) as w from part)")
def node_typing(spark, sf_dir):
    classes = F.array("p_type", "p_name", sample_word())
    return table(spark, sf_dir, "part").select("p_partkey", O.node_type(classes, F.col("p_size") < 5, F.col("p_size") > 45, F.lit("UNKNOWN")).alias("kind"))


@query(f"select p_partkey, case when p_size < 5 then 'HISTORICAL_RELICT' else coalesce({R.first_keyword('lower(w)', V.ONTOLOGY_KEYWORDS, 'null')}, case when p_size > 45 then 'LOC' end, 'UNKNOWN') end as kind from (select *, concat_ws(' ', p_type, {WORDS_SQL}[p_partkey % {N_WORDS} + 1]) as w from part)")
def resolve_type(spark, sf_dir):
    classes = F.array("p_type", sample_word())
    return table(spark, sf_dir, "part").select("p_partkey", O.resolved_type(F.col("p_size") < 5, classes, F.col("p_size") > 45, F.lit("")).alias("kind"))


LABELS = list(V.CIDOC_CLASSES) + ["other", " per "]


@query(f"select p_partkey, {R.lookup('upper(trim(w))', V.CIDOC_CLASSES, repr(V.DEFAULT_CIDOC_CLASS))} as class from (select p_partkey, [{', '.join(map(R.squote, LABELS))}][p_partkey % {len(LABELS)} + 1] as w from part)")
def cidoc_class(spark, sf_dir):
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("p_partkey") % len(LABELS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", O.cidoc_class(label).alias("class"))


NAMES = list(V.CIDOC_RELATIONS) + ["", "other"]


@query(f"select o_orderkey, {R.lookup('coalesce(nullif(w, repr), o_orderpriority)'.replace('repr', repr('')), V.CIDOC_RELATIONS, repr('related_to'))} as relation from (select *, [{', '.join(map(R.squote, NAMES))}][o_orderkey % {len(NAMES)} + 1] as w from orders)")
def relation_map(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("o_orderkey") % len(NAMES) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", O.map_relation(name, F.col("o_orderpriority"), F.lit(None).cast("string")).alias("relation"))


# Ingest: events as claims and metadata, with props as JSON values

CODES = [*V.PROPERTY_RELATIONS, *V.METADATA_PROPERTIES]
CODE_SQL = f"[{', '.join(map(R.squote, CODES))}][event_id % {len(CODES)} + 1]"


def claims(spark, sf_dir):
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.col("event_id") % len(CODES) + 1).cast("int"))
    value = F.concat(F.lit('{"id":"Q'), F.get_json_object("props", "$.k"), F.lit('","latitude":'), F.col("event_id").cast("string"), F.lit(',"longitude":1.5}'))
    kind = F.when(code == "P625", "globe-coordinate").when(code == "P571", "string").otherwise("wikibase-item")
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("E"), F.col("user_id").cast("string")).alias("entity_id"), code.alias("property"), kind.alias("datatype"), value.alias("value"))


@query(f"""select 'E' || user_id as source, property, 'Q' || json_extract_string(props, '$.k') as target, {R.lookup('property', V.PROPERTY_RELATIONS, 'null')} as relation
    from (select *, {CODE_SQL} as property from events) where property in ({', '.join(map(R.squote, V.PROPERTY_RELATIONS))})""")
def claim_split(spark, sf_dir):
    return ingest.claim_split(claims(spark, sf_dir))[0]


def metadata(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("entity_id"), F.col("event_type").alias("property"), F.get_json_object("props", "$.k").alias("target"), F.col("event_id").alias("ord"))


@query("select user_id::varchar as entity_id, event_type as property, string_agg(json_extract_string(props, '$.k'), '|' order by event_id) as targets from events where json_extract_string(props, '$.k') is not null group by all")
def metadata_lookup(spark, sf_dir):
    return ingest.metadata_lookup(metadata(spark, sf_dir), "ord").withColumn("targets", F.array_join("targets", "|"))


@query("select user_id::varchar as entity_id, event_type as property, arg_min(json_extract_string(props, '$.k'), event_id) as target from events where json_extract_string(props, '$.k') is not null group by all")
def first_metadata(spark, sf_dir):
    return ingest.first_metadata(metadata(spark, sf_dir), "ord")


@query("select user_id, event_type, arg_max(value, event_id) as value from events group by all")
def upsert_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id")
    half = table(spark, sf_dir, "events").agg(F.max("event_id") / 2).first()[0] or 0
    return ingest.upsert(rows.where(F.col("event_id") <= half), rows.where(F.col("event_id") > half), ["user_id", "event_type"], "event_id").drop("event_id")


@query("select user_id, arg_max(event_type, event_id) as event_type, max(event_id) as event_id from events group by user_id")
def entity_dedup_last(spark, sf_dir):
    return ingest.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_id")


@query("select user_id, event_type, min(event_id) as event_id from events group by all")
def relation_dedup_first(spark, sf_dir):
    return ingest.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id", last=False)


@query("""select coalesce(o.user_id, n.user_id) as user_id, coalesce(n.views, o.views) as views, coalesce(n.clicks, o.clicks) as clicks
    from (select user_id, max(value) filter (event_type = 'view') as views, max(value) filter (event_type = 'click') as clicks from events where event_id % 2 = 0 group by 1) o
    full join (select user_id, max(value) filter (event_type = 'view') as views, max(value) filter (event_type = 'click') as clicks from events where event_id % 2 = 1 group by 1) n on o.user_id = n.user_id""")
def property_merge(spark, sf_dir):
    at = lambda k: F.max(F.when(F.col("event_type") == k, F.col("value"))).alias(f"{k}s")
    half = lambda r: table(spark, sf_dir, "events").where(F.col("event_id") % 2 == r).groupBy("user_id").agg(at("view"), at("click"))
    return ingest.merge_properties(half(0), half(1), "user_id")


@query("select subject, coalesce(predicate, 'related_to') as predicate, object from (select distinct user_id as subject, nullif(event_type, 'error') as predicate, json_extract_string(props, '$.k') as object from events) where object is not null")
def triples_distinct(spark, sf_dir):
    return ingest.triples(table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("relation"), F.get_json_object("props", "$.k").alias("target")))


@query("""with v as (select user_id::varchar as e, json_extract_string(props, '$.k') as t from events where event_type = 'view')
    select count(*) as n_rows, count(distinct e) as n_entities, (select string_agg(e || ':' || t, '|' order by e, t) from (select * from v order by e, t limit 5)) as sample from v""")
def coordinate_audit(spark, sf_dir):
    found = ingest.coordinate_audit(metadata(spark, sf_dir).withColumn("property", F.when(F.col("property") == "view", "P625").otherwise(F.col("property"))))
    return found.withColumn("sample", F.array_join(F.transform("sample", lambda x: F.concat(x.entity_id, F.lit(":"), x.target)), "|"))


@query("select l_orderkey, string_agg(a, '|' order by a) as aliases from (select l_orderkey, l_returnflag as a from lineitem union select l_orderkey, l_linestatus from lineitem) group by 1")
def alias_union(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("a"), F.collect_set("l_linestatus").alias("b"))
    return rows.select("l_orderkey", ingest.alias_union(F.col("a"), F.col("b")).alias("aliases"))


@query("select p_partkey, nullif(case when p_size < 10 then '' else p_name end, '') as p_name from part")
def prune_empty(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", ingest.pruned(F.when(F.col("p_size") < 10, "").otherwise(F.col("p_name"))).alias("p_name"))


@query("select l_orderkey, string_agg('P' || l_partkey, ',' order by l_linenumber, l_partkey, l_returnflag) as ids, string_agg(l_returnflag, ',' order by l_linenumber, l_partkey, l_returnflag) as labels from lineitem group by 1")
def flatten_structs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.col("l_returnflag").alias("label")))).alias("x"))
    flat = rows.select("l_orderkey", *ingest.flattened("x", ["l_partkey", "label"]))
    return flat.select("l_orderkey", F.array_join(F.transform("x_l_partkey", lambda x: F.concat(F.lit("P"), x.cast("string"))), ",").alias("ids"), F.array_join("x_label", ",").alias("labels"))


@query("select p_partkey, nullif(case when p_size < 10 then '' else p_name end, '') as name, case when p_size >= 20 then p_brand end as listed, case when p_size >= 30 then p_type end as mapped, p_size from part")
def prune_properties(spark, sf_dir):
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(F.col("p_size") < 10, "").otherwise(F.col("p_name")).alias("name"), F.when(F.col("p_size") >= 20, F.array("p_brand")).otherwise(none).alias("listed"),
        F.when(F.col("p_size") >= 30, F.create_map(F.lit("type"), "p_type")).otherwise(F.create_map().cast("map<string,string>")).alias("mapped"), "p_size",
    )
    return ingest.prune_properties(rows).withColumns({"listed": F.array_join("listed", ","), "mapped": F.try_element_at("mapped", F.lit("type"))})


def fetched(spark, sf_dir):
    """Customers as entities with labels in two languages, as far as they have them."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), k.cast("string")).alias("id"), F.when(k % 3 == 0, F.col("c_name")).alias("label_vi"), F.when(k % 2 == 0, F.concat(F.lit("EN "), "c_name")).otherwise("").alias("label_en"),
        F.when(k % 5 == 0, "").alias("description_vi"), F.when(k % 2 == 1, F.col("c_mktsegment")).alias("description_en"), F.when(k % 4 == 0, F.array("c_mktsegment", F.lit("x"))).alias("aliases_vi"),
    )


LABEL_VI = "case when c_custkey % 3 = 0 then c_name when c_custkey % 2 = 0 then 'EN ' || c_name"


@query(f"select 'C' || c_custkey as id, {LABEL_VI} else '' end as label, case when c_custkey % 2 = 1 then c_mktsegment else '' end as description, case when c_custkey % 4 = 0 then c_mktsegment || '|x' else '' end as aliases from customer")
def entity_info(spark, sf_dir):
    return ingest.entity_info(fetched(spark, sf_dir)).withColumn("aliases", F.array_join("aliases", "|"))


@query(f"select o_orderkey, 'C' || o_custkey as target, {LABEL_VI} end as target_label from orders left join customer on c_custkey = o_custkey and c_mktsegment != 'BUILDING'")
def resolve_labels(spark, sf_dir):
    """Orders' customers as claims' targets; those of one segment were never fetched."""
    known = table(spark, sf_dir, "customer").where("c_mktsegment != 'BUILDING'").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"))
    claims_ = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("target"))
    return ingest.resolve_labels(claims_, fetched(spark, sf_dir).join(known, "id", "left_semi"))


CLAIM_JSON = """'{"id":"Q' || json_extract_string(props, '$.k') || '","latitude":' || event_id || ',"longitude":1.5}'"""


@query(f"""select 'E' || user_id as entity_id, property, case property when 'P625' then '{{"latitude":' || event_id::double || ',"longitude":1.5}}' when 'P571' then {CLAIM_JSON}
    else '{{"id":"Q' || json_extract_string(props, '$.k') || '"}}' end as target from (select *, {CODE_SQL} as property from events) where property in ({', '.join(map(R.squote, V.METADATA_PROPERTIES))})""")
def claim_metadata(spark, sf_dir):
    return ingest.claim_split(claims(spark, sf_dir))[1]


@query(f"""with m as (select 'E' || user_id as id, {CODE_SQL} as property, event_id, json_extract_string(props, '$.k') as k, event_type from events),
    g as (select id, min(event_id) filter (property = 'P625')::double as latitude, string_agg('Q' || k, ',' order by event_id) filter (property = 'P31') as classes, count(*) filter (property = 'P1435') > 0 as marked, min(event_type) as ner from m group by 1)
    select id, case when marked or latitude is not null then 'E27_Site' else 'E1_CRM_Entity' end as type, case when marked or latitude is not null then 'FAC' else ner end as ner_type, latitude, coalesce(classes, '') as classes from g""")
def build_nodes(spark, sf_dir):
    """Users as entities, with a tagger's type (their first event type) and the metadata of their claims."""
    users = table(spark, sf_dir, "events").groupBy(F.concat(F.lit("E"), F.col("user_id").cast("string")).alias("id")).agg(F.min("event_type").alias("ner"))
    entities = users.withColumns({"label": F.col("id"), "description": F.lit(None).cast("string")})
    order = F.row_number().over(Window.partitionBy("entity_id", "property").orderBy("event_id"))
    found = claims(spark, sf_dir).withColumn("ord", order).withColumn("target", F.try_parse_json("value")).where(F.col("property").isin(V.METADATA_PROPERTIES))
    nodes = ingest.build_nodes(entities, found, F.col("ner"))
    return nodes.select("id", "type", "ner_type", "latitude", F.array_join(F.transform("wd_properties.instance_of", lambda x: x.id), ",").alias("classes"))


@query(f"""select distinct 'E' || user_id as source, 'Q' || json_extract_string(props, '$.k') as target, {R.lookup(R.lookup('property', V.PROPERTY_RELATIONS, 'null'), V.CIDOC_RELATIONS, repr('related_to'))} as relation, {R.lookup('property', V.PROPERTY_RELATIONS, 'null')} as original_relation
    from (select *, {CODE_SQL} as property from events) where property in ({', '.join(map(R.squote, V.PROPERTY_RELATIONS))})""")
def map_relations(spark, sf_dir):
    return ingest.map_relations(ingest.claim_split(claims(spark, sf_dir))[0])


@query("""select '{"k":' || json_extract_string(props, '$.k') || ',"t":"' || event_type || '"}' as key, count(*) as n from events group by 1""")
def canonical_json(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"t": "'), "event_type", F.lit('", "k": '), k, F.lit("}"))).otherwise(F.concat(F.lit('{"k":'), k, F.lit(',"t":"'), "event_type", F.lit('"}')))
    return table(spark, sf_dir, "events").select(ingest.canonical_json(text).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


# Sources and sinks: what is written is read again


@query("select c_name as input_name, 'Q' || c_custkey as wikidata_id, upper(c_name) as canonical_name, case when c_custkey % 2 = 0 then c_mktsegment || '|é,\"x' else '' end as aliases from customer")
def seeds_round_trip(spark, sf_dir):
    aliases = F.when(F.col("c_custkey") % 2 == 0, F.array("c_mktsegment", F.lit('é,"x'))).otherwise(F.array().cast("array<string>"))
    seeds = table(spark, sf_dir, "customer").select(F.col("c_name").alias("input_name"), F.concat(F.lit("Q"), F.col("c_custkey").cast("string")).alias("wikidata_id"), F.upper("c_name").alias("canonical_name"), aliases.alias("aliases"))
    path = fresh_folder(spark, "seeds")
    files.write_seeds(seeds, path)
    return files.read_seeds(spark, path).withColumn("aliases", F.array_join("aliases", "|"))


@query("select 'E' || user_id as source, event_type as property, json_extract_string(props, '$.k') as target, case when event_id % 3 = 0 then null else 'é' || event_id end as relation from events")
def records_round_trip(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("E"), F.col("user_id").cast("string")).alias("source"), F.col("event_type").alias("property"), F.get_json_object("props", "$.k").alias("target"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("é"), F.col("event_id").cast("string"))).alias("relation")
    )
    path = fresh_folder(spark, "records")
    files.write_records(rows, path)
    return files.read_records(spark, path, schemas.RELATIONS, lines=True)


@query(f"with {R.EDGES} select source as subject, relation as predicate, target as object from edges")
def triples_round_trip(spark, sf_dir):
    path = fresh_folder(spark, "triples")
    files.write_triples(graph.star_edges(spark, sf_dir).select(F.col("source").alias("subject"), F.col("relation").alias("predicate"), F.col("target").alias("object")), path)
    return files.read_triples(spark, path)


@query(f"with {R.NODES}, {R.EDGES} select source, relation, target, s.label as source_label, t.label as target_label from edges left join nodes s on s.id = source left join nodes t on t.id = target where relation like 'P53%'")
def graph_round_trip(spark, sf_dir):
    path = fresh_folder(spark, "graph")
    files.write_graph(graph.star_nodes(spark, sf_dir), graph.star_edges(spark, sf_dir), path)
    nodes, edges = files.read_graph(spark, path)
    s, t = (nodes.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label")) for end in ("source", "target"))
    return edges.where("relation like 'P53%'").join(s, "source", "left").join(t, "target", "left").select("source", "relation", "target", "source_label", "target_label")


# Similarity, over distinct part names and brands


def names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()


SORTED = "list_aggregate(list_sort(string_split({0}, ' ')), 'string_agg', ' ')"


@query(f"with recursive names as (select distinct p_name as name from part), pairs as (select x.name as a, y.name as b from names x join names y on x.name < y.name and x.name[1] = y.name[1]), {R.LCS} select a, b, round(200.0 * n / (length(a) + length(b)), 4) as ratio from lcs")
def ratio_pairs(spark, sf_dir):
    n = names(spark, sf_dir).withColumn("k", F.substring("name", 1, 1))
    pairs = n.select(F.col("name").alias("a"), "k").join(n.select(F.col("name").alias("b"), "k"), "k").where("a < b")
    return pairs.select("a", "b", F.round(S.ratio(F.col("a"), F.col("b")), 4).alias("ratio"))


@query(f"""with recursive names as (select distinct p_name as name from part), raw as (select x.name as l, y.name as r from names x join names y on x.name < y.name and x.name[1] = y.name[1]),
    pairs as (select {SORTED.format('l')} as a, {SORTED.format('r')} as b from raw), {R.LCS} select l as a, r as b, round(200.0 * n / (length(l) + length(r)), 4) as ratio from raw join lcs on lcs.a = {SORTED.format('l')} and lcs.b = {SORTED.format('r')}""")
def token_sort_pairs(spark, sf_dir):
    n = names(spark, sf_dir).withColumn("k", F.substring("name", 1, 1))
    pairs = n.select(F.col("name").alias("a"), "k").join(n.select(F.col("name").alias("b"), "k"), "k").where("a < b")
    return pairs.select("a", "b", F.round(S.token_sort_ratio(F.col("a"), F.col("b")), 4).alias("ratio"))


def best_links(queries: DataFrame, entities: DataFrame, keys: list[str]) -> DataFrame:
    """Each query's entity (of equal keys) with the best token-set ratio of LINKING_RATIO or more. Only those that
    share one of token_set_keys() are compared, which an equi-join finds and which leaves out none."""
    q = queries.select(*keys, "q", F.explode(S.token_set_keys(F.col("q"))).alias("part"))
    e = entities.select(*keys, "name", F.explode(S.token_set_keys(F.col("name"))).alias("part"))
    near = q.join(e, [*keys, "part"]).select(*keys, "q", "name").distinct()
    scored = near.withColumn("value", S.token_set_ratio(F.col("q"), F.col("name"))).where(F.col("value") >= V.LINKING_RATIO)
    return scored.groupBy(*keys, "q").agg(F.max_by("name", F.struct("value", F.col("name"))).alias("name"), F.round(F.max("value"), 4).alias("value"))


def _best_links_sql(keys: str, q: str, e: str) -> str:
    """All pairs, with their token-set ratios."""
    on, key = (f"q.{keys} = e.{keys}", f"{keys}, ") if keys else ("true", "")
    own = lambda c: f"list_distinct(list_filter(string_split_regex({c}, '\\s+'), lambda x: x != ''))"
    row = lambda c: f"coalesce(list_aggregate(list_sort({c}), 'string_agg', ' '), '')"
    return f"""with recursive q as ({q}), e as ({e}), raw as (select {f"q.{keys}, " if keys else ""}q, name, {own("q")} as x, {own("name")} as y from q join e on {on}),
    cut as (select *, {row("list_intersect(x, y)")} as common, {row("list_filter(x, lambda t: not list_contains(y, t))")} as l, {row("list_filter(y, lambda t: not list_contains(x, t))")} as r from raw where len(x) > 0 and len(y) > 0),
    forms as (select *, trim(concat_ws(' ', nullif(common, ''), nullif(l, ''))) as one, trim(concat_ws(' ', nullif(common, ''), nullif(r, ''))) as two from cut),
    pairs as (select distinct one as a, two as b from forms union select common, one from forms where common != '' union select common, two from forms where common != ''), {R.LCS},
    ratios as (select a, b, 200.0 * n / (length(a) + length(b)) as v from lcs),
    scored as (select {key}q, name, case when common != '' and (l = '' or r = '') then 100.0 else greatest(v1.v, coalesce(v2.v, 0), coalesce(v3.v, 0)) end as value from forms
      join ratios v1 on v1.a = one and v1.b = two left join ratios v2 on v2.a = common and v2.b = one and common != '' left join ratios v3 on v3.a = common and v3.b = two and common != '')
    select {key}q, arg_max(name, struct_pack(v := value, n := name)) as name, round(max(value), 4) as value from scored where value >= {V.LINKING_RATIO} group by all"""


@query(_best_links_sql("", "select distinct lower(concat_ws(' ', p_name, p_type)) as q from part", "select distinct p_name as name from part"))
def token_set_best(spark, sf_dir):
    q = table(spark, sf_dir, "part").select(F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("q")).distinct()
    return best_links(q, names(spark, sf_dir), [])


@query(_best_links_sql("type", "select distinct p_type as type, lower(concat_ws(' ', p_name, p_type)) as q from part", "select distinct p_type as type, p_name as name from part"))
def token_set_by_type(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    q = parts.select(F.col("p_type").alias("type"), F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("q")).distinct()
    return best_links(q, parts.select(F.col("p_type").alias("type"), F.col("p_name").alias("name")).distinct(), ["type"])


@query("""with e as (select vec_id, embedding from embeddings) select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 4) as cosine from e a join e b on b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("b"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select(F.col("vec_id").alias("a"), "b", F.round(S.cosine(F.col("embedding"), F.col("other")), 4).alias("cosine"))


@query("""with q as (select * from embeddings where vec_id % 20 = 0), p as (select q.vec_id as q, e.vec_id as id, list_cosine_similarity(q.embedding::double[], e.embedding::double[]) as c from q join embeddings e on e.vec_id != q.vec_id),
    r as (select *, row_number() over (partition by q order by round(c, 9) desc, id) as n from p where isfinite(c)) select q, id, n as place, round(c, 4) as cosine from r where n <= 5""")
def cosine_topk(spark, sf_dir):
    """The five of all vectors that are nearest to a query, for the stated queries (ids divisible by 20)."""
    e = table(spark, sf_dir, "embeddings")
    return S.nearest(e, e.where(F.col("vec_id") % 20 == 0)).withColumn("cosine", F.round("cosine", 4))


# Refinement, over distinct part names and types as labels


def named_nodes(spark, sf_dir):
    """A node for each label and type of parts, in the order of the first part."""
    parts = table(spark, sf_dir, "part").groupBy("p_name", "p_type", "p_brand").agg(F.min("p_partkey").alias("ord"))
    return parts.select(F.concat(F.lit("P"), F.col("ord").cast("string")).alias("id"), "ord", F.col("p_name").alias("label"), F.col("p_type").alias("type"), F.col("p_brand").alias("ner_type"))


NAMED = "named as (select 'P' || min(p_partkey) as id, min(p_partkey) as ord, p_name as label, p_type as type, p_brand as ner_type from part group by p_name, p_type, p_brand)"


@query(f"""with recursive {NAMED}, raw as (select x.id as l, x.ord as lo, y.id as r, y.ord as ro, {SORTED.format(R.norm_lower('x.label'))} as a, {SORTED.format(R.norm_lower('y.label'))} as b from named x join named y
      on x.ord < y.ord and x.type = y.type and x.ner_type = y.ner_type and {R.norm_lower('x.label')}[1] = {R.norm_lower('y.label')}[1]),
    pairs as (select distinct a, b from raw), {R.LCS}
    select l as a, r as b from raw join lcs on raw.a = lcs.a and raw.b = lcs.b where 200.0 * n / (length(raw.a) + length(raw.b)) >= 70""")
def blocked_same_entity(spark, sf_dir):
    return refine.same_entity_pairs(named_nodes(spark, sf_dir), least=70).select("a", "b")


@query(f"""with recursive {NAMED}, raw as (select x.id as l, x.ord as lo, y.id as r, y.ord as ro, {SORTED.format(R.norm_lower('x.label'))} as a, {SORTED.format(R.norm_lower('y.label'))} as b from named x join named y
      on x.ord < y.ord and x.type = y.type and x.ner_type = y.ner_type and {R.norm_lower('x.label')}[1] = {R.norm_lower('y.label')}[1]),
    pairs as (select distinct a, b from raw), {R.LCS},
    near as (select l, lo, r, ro from raw join lcs on raw.a = lcs.a and raw.b = lcs.b where 200.0 * n / (length(raw.a) + length(raw.b)) >= 70),
    waits as (select r as id, row_number() over (order by ro) as k, list(l order by lo) as before from near group by r, ro),
    walk as (select 0::bigint as k, []::varchar[] as gone, null::varchar as dropped, null::varchar as kept
      union all select w.k, case when f is null then gone else list_append(gone, w.id) end, case when f is not null then w.id end, f
      from (select w.*, s.gone, list_filter(w.before, lambda x: not list_contains(s.gone, x))[1] as f from walk s join waits w on w.k = s.k + 1) w)
    select dropped, kept from walk where dropped is not null""")
def entity_resolution(spark, sf_dir):
    return refine.resolve(named_nodes(spark, sf_dir), least=70)


def region_aliases(spark, sf_dir):
    """Customers of one nation and segment as duplicates of the first."""
    c = table(spark, sf_dir, "customer")
    first = c.groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("first"))
    return c.join(first, ["c_nationkey", "c_mktsegment"]).where("c_custkey != first").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("dropped"), F.concat(F.lit("C"), F.col("first").cast("string")).alias("kept"))


ALIASES = "aliases as (select 'C' || c_custkey as dropped, 'C' || min(c_custkey) over (partition by c_nationkey, c_mktsegment) as kept from customer qualify dropped != kept)"


@query(f"""with {ALIASES}, n as (select 'C' || c_custkey as id, c_custkey as ord, c_name as label, case when c_custkey % 3 = 0 then c_acctbal end as latitude, case when c_custkey % 5 = 0 then c_mktsegment else '' end as address from customer),
    m as (select coalesce(a.kept, n.id) as of, n.*, a.kept is not null as d from n left join aliases a on n.id = a.dropped)
    select of as id, arg_min(label, case when d then 1e9 else 0 end + ord) as label, arg_min(latitude, case when d then 1e9 else 0 end + ord) filter (latitude is not null) as latitude,
      arg_min(address, case when d then 1e9 else 0 end + ord) filter (address != '') as address, coalesce(string_agg(label, '|' order by label) filter (d), '') as aliases from m group by 1""")
def merge_attributes(spark, sf_dir):
    none = F.lit(None).cast("string")
    nodes = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_custkey").alias("ord"), F.col("c_name").alias("label"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("latitude"),
        F.lit(None).cast("double").alias("longitude"), none.alias("inception"), F.when(F.col("c_custkey") % 5 == 0, F.col("c_mktsegment")).otherwise("").alias("address"),
    )
    return refine.merge_nodes(nodes, region_aliases(spark, sf_dir)).select("id", "label", "latitude", "address", F.array_join("aliases", "|").alias("aliases"))


@query(f"with {R.EDGES}, {ALIASES} select distinct coalesce(s.kept, source) as source, relation, coalesce(t.kept, target) as target from edges left join aliases s on source = s.dropped left join aliases t on target = t.dropped where coalesce(s.kept, source) != coalesce(t.kept, target)")
def remap_relations(spark, sf_dir):
    return refine.remap_relations(graph.star_edges(spark, sf_dir, once=False), region_aliases(spark, sf_dir))


def dated(spark, sf_dir):
    when = F.concat(F.lit("+"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("id"), F.when(F.col("o_orderstatus") != "P", when).alias("inception"))


@query("select distinct 'YEAR_' || year(o_orderdate) as id, year(o_orderdate)::varchar as label, 'E52_Time_Span' as type from orders where o_orderstatus != 'P'")
def temporal_nodes(spark, sf_dir):
    return refine.temporal_nodes(dated(spark, sf_dir))


@query("select 'O' || o_orderkey as source, 'P4_has_time_span' as relation, 'YEAR_' || year(o_orderdate) as target from orders where o_orderstatus != 'P'")
def temporal_edges(spark, sf_dir):
    return refine.temporal_edges(dated(spark, sf_dir))


@query(f"""with recursive n as (select 'P' || min(p_partkey) as id, min(p_partkey) as ord, p_name as label from part group by p_name),
    raw as (select x.id as l, y.id as r, {R.norm_lower('x.label')} as a, {R.norm_lower('y.label')} as b from n x join n y on x.ord < y.ord and x.label[1] = y.label[1]), pairs as (select distinct a, b from raw), {R.LCS}
    select l as source, r as target, 'related_to' as relation, round(200.0 * n / (length(raw.a) + length(raw.b)), 2) as confidence from raw join lcs on raw.a = lcs.a and raw.b = lcs.b where 200.0 * n / (length(raw.a) + length(raw.b)) >= 75""")
def cross_links(spark, sf_dir):
    parts = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("ord"))
    return refine.cross_links(parts.select(F.concat(F.lit("P"), F.col("ord").cast("string")).alias("id"), "ord", F.col("p_name").alias("label")), least=75)


def terms(spark, sf_dir):
    """Labels to look for: the first three words of each benchmark item, and its first one."""
    b = table(spark, sf_dir, "benchmark").select("item_id", S.tokens(F.col("text")).alias("w"))
    both = F.array(F.struct(F.lit("a").alias("k"), F.array_join(F.slice("w", 1, 3), " ").alias("label")), F.struct(F.lit("b").alias("k"), F.try_element_at("w", F.lit(1)).alias("label")))
    return b.select("item_id", F.explode(both).alias("x")).select(F.concat(F.lit("T"), F.col("item_id").cast("string"), F.col("x.k")).alias("id"), F.col("x.label").alias("label"))


TERMS = r"terms as (select 'T' || item_id || k as id, label from (select item_id, 'a' as k, list_aggregate(list_filter(string_split_regex(text, '\s+'), lambda x: x != '')[1:3], 'string_agg', ' ') as label from benchmark union all select item_id, 'b', list_filter(string_split_regex(text, '\s+'), lambda x: x != '')[1] from benchmark))"


@query(rf"""with {TERMS}, n as (select id, {R.norm_lower('label')} as label from terms), m as (select id, label, list_filter(string_split_regex(label, '[^\p{{L}}\p{{N}}_]+'), lambda x: x != '')[1] as word from n where length(label) >= 2),
    d as (select doc_id, {R.norm_lower('text')} as text from documents), w as (select distinct doc_id, unnest(string_split_regex(text, '[^\p{{L}}\p{{N}}_]+')) as word from d),
    c as (select distinct m.id, m.label, w.doc_id from m join w on w.word = m.word)
    select distinct c.id as entity_id, d.doc_id::varchar as chunk_id, 'documents' as source from c join d on d.doc_id = c.doc_id where contains(d.text, c.label) and regexp_matches(' ' || d.text || ' ', '[^\p{{L}}\p{{N}}_]' || regexp_escape(c.label) || '[^\p{{L}}\p{{N}}_]')""")
def provenance(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.lit("documents").alias("source"), "text")
    return refine.provenance(terms(spark, sf_dir), chunks)


# Graph


@query(f"with {R.NODES} select * from nodes")
def graph_nodes(spark, sf_dir):
    return graph.star_nodes(spark, sf_dir)


@query(f"with {R.EDGES} select * from edges")
def graph_edges(spark, sf_dir):
    return graph.star_edges(spark, sf_dir)


@query(f"with {R.NODES}, {R.EDGES} select distinct source, relation, target from edges where source in (select id from nodes where type != 'E53_Place') and target in (select id from nodes where type != 'E53_Place')")
def edge_load_semi(spark, sf_dir):
    return graph.load_edges(graph.star_edges(spark, sf_dir, once=False), graph.star_nodes(spark, sf_dir).where("type != 'E53_Place'"))


@query(f"with {R.NODES} select id, count(*) as n from nodes group by id having count(*) > 1")
def unique_ids(spark, sf_dir):
    return graph.repeated_ids(graph.star_nodes(spark, sf_dir))


@query(f"with {R.NODES} select id, label, type from nodes where id = 'N3'")
def node_lookup(spark, sf_dir):
    return graph.star_nodes(spark, sf_dir).where("id = 'N3'")


def starts(spark, sf_dir, kinds=("E74_Group", "E53_Place")):
    return graph.star_nodes(spark, sf_dir).where(F.col("type").isin(*kinds)).select("id")


def _expand_sql(ways: str, where: str, limit: int) -> str:
    return f"with {R.NODES}, {R.EDGES}, {R.WAYS}, f as (select distinct n.id, w.relation, w.dst as neighbour from nodes n join ways w on n.id = w.src where {where} and {ways}), g as (select *, row_number() over (partition by id order by relation, neighbour) as k from f) select id, relation, neighbour from g where k <= {limit}"


@query(_expand_sql("forward", "n.type = 'E22_Human-Made_Object'", 50))
def expand_out(spark, sf_dir):
    return graph.expand(starts(spark, sf_dir, ["E22_Human-Made_Object"]), graph.star_edges(spark, sf_dir, once=False), directed=True, limit=50)


@query(_expand_sql("true", "n.type in ('E74_Group', 'E53_Place')", 100))
def expand_both(spark, sf_dir):
    return graph.expand(starts(spark, sf_dir), graph.star_edges(spark, sf_dir, once=False))


@query(_expand_sql("w.relation = 'P108_was_produced_by'", "n.id = 'S1'", 100))
def expand_filtered(spark, sf_dir):
    return graph.expand(starts(spark, sf_dir).where("id = 'S1'"), graph.star_edges(spark, sf_dir, once=False), ["P108_was_produced_by"])


@query(_expand_sql("w.relation in ('P108_was_produced_by', 'P53_has_former_or_current_location')", "n.type in ('E74_Group', 'E53_Place')", 100))
def expand_batch(spark, sf_dir):
    return graph.expand(starts(spark, sf_dir), graph.star_edges(spark, sf_dir, once=False), ["P108_was_produced_by", "P53_has_former_or_current_location"])


@query(f"with {R.NODES}, {R.EDGES}, {R.WAYS}, f as (select distinct src as id, relation, dst as neighbour from ways where relation in ('P14_carried_out_by', 'P53_has_former_or_current_location')), g as (select *, row_number() over (partition by id order by relation, neighbour) as k from f) select n.id, relation, neighbour from nodes n left join g on g.id = n.id and k <= 100")
def expand_every(spark, sf_dir):
    """Every node's neighbours by two relations; parts and years, which have none, too."""
    return graph.expand(graph.star_nodes(spark, sf_dir), graph.star_edges(spark, sf_dir, once=False), ["P14_carried_out_by", "P53_has_former_or_current_location"], every=True)


@query(f"""with {R.NODES}, {R.EDGES}, w as (select src, relation, dst, case when forward then concat_ws('|', src, relation, dst) else concat_ws('|', dst, relation, src) end as e from (select source as src, relation, target as dst, true as forward from edges union all select target, relation, source, false from edges)),
    one as (select n.id as s, [n.id, dst] as nodes, [relation] as rels, [e] as used, dst as d from nodes n join w on w.src = n.id where n.type = 'E53_Place'),
    two as (select s, list_append(nodes, w.dst) as nodes, list_append(rels, w.relation) as rels, list_append(used, w.e) as used, w.dst as d from one join w on w.src = d and not list_contains(used, w.e)),
    three as (select s, list_append(nodes, w.dst) as nodes, list_append(rels, w.relation) as rels, list_append(used, w.e) as used, w.dst as d from (select * from two where s in (select s from one group by 1 having count(*) < 100)) x join w on w.src = d and not list_contains(used, w.e)),
    every as (select s, nodes, rels from one union all select s, nodes, rels from two union all select s, nodes, rels from three)
    select s as id, array_to_string(nodes, '>') as path, array_to_string(rels, '>') as relations from every qualify row_number() over (partition by s order by len(rels), nodes, rels) <= 100""")
def multi_hop_limited(spark, sf_dir):
    """Up to three edges from each place, 100 paths of each."""
    start = graph.star_nodes(spark, sf_dir).where("type = 'E53_Place'")
    found = graph.paths(start, graph.star_edges(spark, sf_dir), 3, limit=100)
    return found.select(F.element_at("nodes", 1).alias("id"), F.array_join("nodes", ">").alias("path"), F.array_join("relations", ">").alias("relations"))


@query("""with s as (select s_suppkey, s_nationkey, n_regionkey, lower(s_name) as a, lower(n_name) as b, lower(r_name) as c from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where contains(lower(s_name), 'supplier#'))
    select 'S' || s_suppkey || '>N' || s_nationkey as path, 1::bigint as n_edges from s where contains(a, 'nation_1') or contains(b, 'nation_1') union all
    select 'S' || s_suppkey || '>N' || s_nationkey || '>R' || n_regionkey, 2 from s where contains(a, 'nation_1') or contains(b, 'nation_1') or contains(c, 'nation_1')""")
def location_chain_target(spark, sf_dir):
    return graph.location_chain(graph.star_nodes(spark, sf_dir), graph.star_edges(spark, sf_dir), "Supplier#", hops=2, target="NATION_1")


@query(f"""with {R.NODES}, {R.EDGES}, w as (select src, relation, dst, case when forward then concat_ws('|', src, relation, dst) else concat_ws('|', dst, relation, src) end as e from (select source as src, relation, target as dst, true as forward from edges union all select target, relation, source, false from edges)),
    one as (select n.id as s, dst as d1, e as e1 from nodes n join w on n.id = w.src where regexp_matches(n.label, '(?i).*nation_1.*')), two as (select s, d1, w.dst as d2 from one join w on w.src = d1 and w.e != e1)
    select distinct path from (select s || '>' || d1 as path from one union all select s || '>' || d1 || '>' || d2 from two) order by path limit 30""")
def subgraph_context_hops(spark, sf_dir):
    start = graph.star_nodes(spark, sf_dir).where(F.rlike("label", F.lit("(?i).*nation_1.*"))).select("id")
    return graph.first_paths(start, graph.star_edges(spark, sf_dir, once=False), 2, 30)


@query(f"""with {R.NODES}, {R.EDGES}, {R.WAYS}, hit as (select * from nodes where regexp_matches(label, '(?i).*nation_1.*')),
    linked as (select h.label as source, relation, n.label as target from ways join hit h on h.id = src join nodes n on n.id = dst order by all limit 10)
    select * from (select 'node' as kind, id as source, null::varchar as relation, label as target from hit order by id limit 5) union all select 'edge', * from linked""")
def neighbourhood(spark, sf_dir):
    return graph.neighbourhood(graph.star_nodes(spark, sf_dir), graph.star_edges(spark, sf_dir), "(?i).*nation_1.*")


DEGREES = "select n.type, e.relation, count(*) as n from {nodes} n join {edges} e on e.source = n.id group by n.type, e.relation"


@query(f"with {R.NODES}, {R.EDGES} {DEGREES.format(nodes='nodes', edges='edges')}")
def graph_sql(spark, sf_dir):
    return graph.run_sql(graph.star_nodes(spark, sf_dir), graph.star_edges(spark, sf_dir), DEGREES)


@query(f"""with {R.EDGES}, w as (select src, relation, dst, case when forward then concat_ws('|', src, relation, dst) else concat_ws('|', dst, relation, src) end as e from (select source as src, relation, target as dst, true as forward from edges union all select target, relation, source, false from edges)),
    one as (select 'R' || r_regionkey as s, relation as r1, dst as d1, e as e1 from region join w on w.src = 'R' || r_regionkey),
    two as (select s, r1, d1, e1, w.relation as r2, w.dst as d2, w.e as e2 from one join w on w.src = d1 and w.e != e1)
    select s || '>' || d1 as path, r1 as relations from one union all select s || '>' || d1 || '>' || d2, r1 || '>' || r2 from two""")
def multi_hop_paths(spark, sf_dir):
    start = graph.star_nodes(spark, sf_dir).where(F.col("id").startswith("R"))
    found = graph.paths(start, graph.star_edges(spark, sf_dir), 2)
    return found.select(F.array_join("nodes", ">").alias("path"), F.array_join("relations", ">").alias("relations"))


@query("""with s as (select s_suppkey, s_nationkey, n_regionkey from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where contains(lower(s_name), 'supplier#00000000') and contains(lower(r_name), 'a'))
    select 'S' || s_suppkey || '>N' || s_nationkey || '>R' || n_regionkey as path, 2::bigint as n_edges from s""")
def location_chain(spark, sf_dir):
    chain = graph.location_chain(graph.star_nodes(spark, sf_dir), graph.star_edges(spark, sf_dir), "Supplier#00000000", hops=2)
    ends = chain.where("n_edges = 2").withColumn("id", F.element_at(F.split("path", ">"), -1))
    return ends.join(graph.star_nodes(spark, sf_dir).where(F.contains(F.lower("label"), F.lit("a"))).select("id"), "id", "left_semi").select("path", "n_edges")


@query(f"with {R.NODES}, {R.EDGES}, {R.WAYS} select distinct n.id || '>' || w.dst as path from nodes n join ways w on n.id = w.src where regexp_matches(n.label, '(?i).*nation_1.*') order by path limit 30")
def subgraph_context(spark, sf_dir):
    start = graph.star_nodes(spark, sf_dir).where(F.rlike("label", F.lit("(?i).*nation_1.*"))).select("id")
    return graph.first_paths(start, graph.star_edges(spark, sf_dir, once=False), 1, 30)


@query(f"with {R.NODES} select id, label from nodes where contains(translate(lower(label), '-_/', '   '), 'nation 1') order by length(label), id limit 10")
def label_search(spark, sf_dir):
    return graph.label_search(graph.star_nodes(spark, sf_dir), "NATION_1").select("id", "label")


@query(f"""with {R.EDGES}, h1 as (select distinct target as id from edges where source in ('P1', 'P2', 'P3')), h2 as (select distinct target as id from edges where source in (select id from h1) except select id from h1),
    h3 as (select distinct target as id from edges where source in (select id from h2) except select id from h1 except select id from h2)
    select id, 0 as hop from (values ('P1'), ('P2'), ('P3')) t(id) union all select id, 1 from h1 union all select id, 2 from h2 union all select id, 3 from h3""")
def bfs_acquire(spark, sf_dir):
    start = graph.star_nodes(spark, sf_dir).where(F.col("id").isin("P1", "P2", "P3")).select("id")
    return graph.reach(start, graph.star_edges(spark, sf_dir), hops=3, budget=200)


@query(f"with {R.NODES} select type, count(*) as n, count(distinct label) as labels from nodes group by type")
def graph_summary(spark, sf_dir):
    return graph.star_nodes(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("labels"))


# Ranking: orders' line numbers as edges of a path, their quantities as similarities


def line_paths(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", ((F.col("l_quantity") + 0.1234567) / 51.7).alias("s")))).alias("x"))
    return rows.select("l_orderkey", F.transform("x", lambda x: x.s).alias("sims"))


LINES = "p as (select l_orderkey, count(*) as n, sum(s / k) as total from (select l_orderkey, (l_quantity + 0.1234567::double) / 51.7::double as s, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity) as k from lineitem) group by 1)"


@query(f"with {LINES} select l_orderkey, round(total / n, 4) as value from p")
def path_relation_score(spark, sf_dir):
    return line_paths(spark, sf_dir).select("l_orderkey", F.round(rank.relation_score(F.col("sims")), 4).alias("value"))


@query(f"with {LINES} select l_orderkey, round(greatest(0.0, 1 - 0.15 * (n - 1))::double, 4) as value from p")
def path_structure_score(spark, sf_dir):
    return line_paths(spark, sf_dir).select("l_orderkey", F.round(rank.structure_score(F.size("sims")), 4).alias("value"))


@query("""with m as (select label, list(x order by k) as mean from (select label, k, avg(embedding[k]::double) as x from (select label, embedding, unnest(range(1, len(embedding) + 1)) as k from embeddings where label is not null) group by 1, 2) group by 1)
    select e.vec_id, round(coalesce(list_cosine_similarity(e.embedding::double[], m.mean), 0), 4) as value from embeddings e left join m on m.label = e.label""")
def path_target_score(spark, sf_dir):
    """Every vector as a target, its label's vector the mean of all rows of that label; 0 where a target has no label."""
    e = table(spark, sf_dir, "embeddings")
    means = e.where("label is not null").select("label", F.posexplode("embedding").alias("k", "x")).groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    q = means.groupBy("label").agg(F.array(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda m: m.x)).alias("labels"))
    return e.join(q, "label", "left").select("vec_id", F.round(F.coalesce(F.array_max(F.transform("labels", lambda l: S.cosine(F.col("embedding"), l))), F.lit(0.0)), 4).alias("value"))


@query(f"with {LINES} select l_orderkey, round(round(0.55::double * (total / n) + 0.25::double * greatest(0.0, 1 - 0.15 * (n - 1))::double, 4), 3) as value from p")
def path_score(spark, sf_dir):
    return line_paths(spark, sf_dir).select("l_orderkey", F.round(rank.path_score(F.col("sims")), 3).alias("value"))


@query("select c_nationkey, greatest(3, floor(round(5 * avg(c_acctbal) / greatest(max(c_acctbal), 0.1), 9)))::int as width from customer group by 1")
def adaptive_width(spark, sf_dir):
    sums = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("mean"), F.max("c_acctbal").alias("most"))
    return sums.select("c_nationkey", rank.adaptive_width(F.lit(5), F.col("mean"), F.col("most")).alias("width"))


def graph_questions(spark, sf_dir, relations: list[str], width: int = 5, depth: int = 1):
    roots = graph.star_nodes(spark, sf_dir).where("type = 'E74_Group'").select(F.col("id").alias("qid"), F.col("id").alias("root"))
    return roots.select("qid", "root", F.array(*map(F.lit, relations)).alias("relations"), F.lit(width).alias("beam_width"), F.lit(depth).alias("max_depth"))


def searched(spark, sf_dir, relations, width=5, depth=1):
    q = graph_questions(spark, sf_dir, relations, width, depth)
    return beam.beam_search(q, graph.star_nodes(spark, sf_dir), graph.star_edges(spark, sf_dir, once=False))


# A supplier's parts by built_by: all have similarity 1 and score 0.8, so that the width is 5.
@query(f"with {R.EDGES}, p as (select target as qid, source as next, row_number() over (partition by target order by source) as k from edges where relation = 'P108_was_produced_by') select qid, k::int as rank, qid || '>' || next as path, 0.8::double as score from p where k <= 5")
def beam_depth1(spark, sf_dir):
    return searched(spark, sf_dir, ["built_by"]).select("qid", "rank", F.array_join("nodes", ">").alias("path"), "score")


PATHS = "select qid, rank, depth, array_to_string(nodes, '>') as path, score from found"


@query(f"{A.suppliers('built_by', 5, 2)} {PATHS}")
def beam_depth2(spark, sf_dir):
    return searched(spark, sf_dir, ["built_by"], depth=2).select("qid", "rank", "depth", F.array_join("nodes", ">").alias("path"), "score")


@query(f"{A.suppliers('', 8, 3)} {PATHS}")
def beam_full(spark, sf_dir):
    return searched(spark, sf_dir, [], width=8, depth=3).select("qid", "rank", "depth", F.array_join("nodes", ">").alias("path"), "score")


@query(f"{A.suppliers('built_by,located_in', 5, 3)} select qid, max(depth) as depth, count(*) as n_paths, max(score) as best from found group by 1")
def early_stop(spark, sf_dir):
    found = searched(spark, sf_dir, ["built_by", "located_in"], depth=3)
    return found.groupBy("qid").agg(F.max("depth").alias("depth"), F.count(F.lit(1)).alias("n_paths"), F.max("score").alias("best"))


@query(f"{A.suppliers('built_by', 5, 2)} select qid, array_to_string(rels, '>') as relations, array_to_string(nodes, '>') as path, score from found qualify row_number() over (partition by qid, rels order by score desc, rank) = 1")
def diversity_rerank(spark, sf_dir):
    found = beam.diverse(searched(spark, sf_dir, ["built_by"], depth=2))
    return found.select("qid", F.array_join("relations", ">").alias("relations"), F.array_join("nodes", ">").alias("path"), "score")


#: Similarities of canonical relations, as a model would give them.
SIMILAR = {("time_span", "part_of"): 0.5, ("located_in", "part_of"): 0.8}


@query(f"""with {R.NODES}, {R.EDGES}, {R.WAYS}, labels as (select id, label from nodes), asked as (select 'O' || o_orderkey as qid, 'O' || o_orderkey as root, 'thuộc về' as key, 5 as beam_width, 2 as max_depth from orders where o_orderpriority = '1-URGENT'),
    targets as (select 'O' || l_orderkey as qid, 'P' || l_partkey as next, max(l_discount * 8) as target from lineitem group by all), {A.beam(2, ["thuộc về"], targets=True, similar=SIMILAR)} {PATHS}""")
def beam_targets(spark, sf_dir):
    """Paths from urgent orders, with similarities of relations and of last nodes to a target."""
    q = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("root"))
    q = q.select(F.col("root").alias("qid"), "root", F.array(F.lit("thuộc về")).alias("relations"), F.lit(5).alias("beam_width"), F.lit(2).alias("max_depth"))
    end = lambda letter, key: F.concat(F.lit(letter), F.col(key).cast("string"))
    targets = table(spark, sf_dir, "lineitem").groupBy(end("O", "l_orderkey").alias("qid"), end("P", "l_partkey").alias("next")).agg(F.max(F.col("l_discount") * 8).alias("target"))
    found = beam.beam_search(q, graph.star_nodes(spark, sf_dir), graph.star_edges(spark, sf_dir, once=False), targets=targets, similar=SIMILAR)
    return found.select("qid", "rank", "depth", F.array_join("nodes", ">").alias("path"), "score")


@query(f"with {R.EDGES}, {R.WAYS}, f as (select distinct src, relation, dst from ways where src in (select 'S' || s_suppkey from supplier)), o as (select *, row_number() over (partition by src order by relation, dst) as k from f), c as (select * from o where k <= 100), m as (select *, row_number() over (partition by src order by k) as j from c where relation = 'P53_has_former_or_current_location') select src as qid, relation, dst as next from m where j <= 15")
def neighbor_filter(spark, sf_dir):
    asked = beam.with_requests(graph_questions(spark, sf_dir, ["located_in"])).withColumn("codes", F.array().cast("array<string>"))
    edges = graph.star_edges(spark, sf_dir, once=False)
    asked, allowed = beam.numbered(step(asked), edges)
    places = step(asked.select(F.col("root").alias("at"), "request").distinct())
    found = beam.neighbours(places, allowed, graph.star_nodes(spark, sf_dir), edges).where("similarity > 0.35")
    return asked.join(found, [asked.root == found["at"], asked.request == found.request]).select("qid", "relation", "next")


# Questions

ASKED = ["Ai là kiến trúc sư của {}?", "{} nằm ở đâu?", "Những công trình nào do kiến trúc sư của {} thiết kế?", "Tọa độ của {}?", "Ai xây dựng {}?", "Mô tả {}"]


def questions(spark, sf_dir):
    """A question about each supplier and nation, in turn of ASKED."""
    rows = graph.star_nodes(spark, sf_dir).where("type = 'E74_Group' or id like 'N%'").withColumn("k", F.substring("id", 2, 20).cast("int"))
    text = F.element_at(F.array(*map(F.lit, ASKED)), F.col("k") % len(ASKED) + 1)
    return rows.select(F.col("id").alias("qid"), F.replace(text, F.lit("{}"), F.col("label")).alias("question"))


QUESTIONS = f"questions as (select id as qid, replace([{', '.join(map(R.squote, ASKED))}][k % {len(ASKED)} + 1], '{{}}', label) as question from (select *, substr(id, 2)::int as k from nodes where type = 'E74_Group' or id like 'N%'))"
MULTI = "contains(lower(question), 'công trình') and (contains(lower(question), 'kiến trúc sư của') or (contains(lower(question), 'kiến trúc sư') and contains(lower(question), 'thiết kế')))"
ASKS = R.first_keyword("trim(lower(question))", V.QUESTION_KEYWORDS, "null")


@query(f"with {R.NODES}, {QUESTIONS} select qid, {MULTI} as multi from questions")
def multi_hop_flag(spark, sf_dir):
    return questions(spark, sf_dir).select("qid", qa.is_multi_hop(F.col("question")).alias("multi"))


PARSED = f"parsed as (select qid, case when {MULTI} then 'architect,built_by' else coalesce({ASKS}, '') end as relations, case when {MULTI} then 'architect_works' else coalesce({ASKS}, 'unknown') end as question_type, case when {MULTI} then 2 else 1 end as reasoning_depth from questions)"


@query(f"with {R.NODES}, {QUESTIONS}, {PARSED} select * from parsed")
def semantic_parse(spark, sf_dir):
    return qa.parse(questions(spark, sf_dir)).select("qid", F.array_join("relations", ",").alias("relations"), "question_type", "reasoning_depth")


@query(f"with {R.NODES}, {QUESTIONS}, {PARSED} select qid, case when reasoning_depth >= 2 then 8 else 5 end as beam_width, case when reasoning_depth >= 2 then 3 else 2 end as max_depth from parsed")
def plan(spark, sf_dir):
    return qa.plan(qa.parse(questions(spark, sf_dir))).select("qid", "beam_width", "max_depth")


@query(f"with {R.NODES}, {QUESTIONS}, l as (select id, label, {R.norm_link('label')} as n from nodes where type in ('E74_Group', 'E53_Place')) select qid, id, label from questions join l on l.n != '' and contains({R.norm_link('question')}, l.n)")
def mentions(spark, sf_dir):
    nodes = graph.star_nodes(spark, sf_dir).where("type in ('E74_Group', 'E53_Place')")
    return qa.mentions(questions(spark, sf_dir), nodes)


@query(f"with {R.NODES}, {QUESTIONS}, l as (select id, label, {R.norm_link('label')} as n from nodes where type in ('E74_Group', 'E53_Place')), m as (select qid, id, label from questions join l on l.n != '' and contains({R.norm_link('question')}, l.n)), r as (select *, row_number() over (partition by qid order by length(label) desc, id) as k from m) select qid, id as root, label as root_label from r where k = 1")
def root_entity(spark, sf_dir):
    return qa.roots(mentions(spark, sf_dir))


@query("""select 'S' || s_suppkey as qid, case s_suppkey % 3 when 0 then 'Vĩ độ: ' || s_suppkey || ', Kinh độ: ' || s_nationkey when 1 then n_name else s_name end as answer,
    case s_suppkey % 3 when 0 then 'coordinates' when 1 then 'country' else 'description' end as property from supplier join nation on s_nationkey = n_nationkey""")
def property_answer(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    nodes = s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_suppkey").alias("latitude"), F.col("s_nationkey").alias("longitude"), F.col("s_name").alias("description"), F.array("n_name").alias("country"), "s_suppkey")
    asked = F.element_at(F.array(F.lit("coordinates"), F.lit("country"), F.lit("description")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    parsed = nodes.select(F.col("id").alias("qid"), F.col("id").alias("root"), F.array(asked).alias("relations"), asked.alias("question_type"))
    return qa.property_answer(parsed, nodes.drop("s_suppkey"))


def answered(spark, sf_dir):
    nodes = graph.star_nodes(spark, sf_dir).where("type in ('E74_Group', 'E53_Place', 'E22_Human-Made_Object')")
    return qa.answer_questions(questions(spark, sf_dir), nodes, graph.star_edges(spark, sf_dir, once=False))


QUESTION_PATHS = A.questions(MULTI, ASKS, QUESTIONS)


@query(f"{QUESTION_PATHS}, {A.FINAL}")
def final_answer(spark, sf_dir):
    return answered(spark, sf_dir).select("qid", "question", "question_type", "root", "reasoning_type", "final_answer", "error")


@query(f"{QUESTION_PATHS} select qid, place::bigint as place, answer, relation, score from answers")
def answers_distinct(spark, sf_dir):
    rows = answered(spark, sf_dir).select("qid", F.posexplode("answers").alias("place", "a"))
    return rows.select("qid", F.col("place").cast("long").alias("place"), "a.answer", "a.relation", "a.score")


@query(f"{A.suppliers('located_in', 5, 1)}, kinds as (select qid, 'located_in' as question_type, '' as root_label from asked), {A.ANSWERS} select qid, best from bests")
def best_answer(spark, sf_dir):
    asked = questions(spark, sf_dir).select("qid", F.lit("located_in").alias("question_type"), F.lit("").alias("root_label"))
    return qa.answers(searched(spark, sf_dir, ["located_in"]), asked).select("qid", "best")


@query(f"with {R.NODES}, {R.EDGES} select distinct 'Fact: ' || coalesce(s.label, 'Unknown') || ' có mối quan hệ ''' || replace(replace(relation, 'P53_', ''), '_', ' ') || ''' với ' || coalesce(t.label, 'Unknown') as fact from edges left join nodes s on s.id = source left join nodes t on t.id = target where relation like 'P53%'")
def evidence(spark, sf_dir):
    nodes = graph.star_nodes(spark, sf_dir)
    edges = graph.star_edges(spark, sf_dir).where("relation like 'P53%'")
    s, t = (nodes.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label")) for end in ("source", "target"))
    return edges.join(s, "source", "left").join(t, "target", "left").select(qa.evidence(edges).alias("fact")).distinct()


REPLY = '{"question_type":"list","relations":["part_of","built_by"],"reasoning_depth":3}'


@query(f"""with {R.NODES}, {QUESTIONS}, q as (select *, {ASKS} as rule, substr(qid, 2)::int % 4 = 0 as replied from questions)
    select qid, case when {MULTI} then 'architect,built_by' when replied then 'part_of,built_by' else coalesce(rule, '') end as relations, case when {MULTI} then 'architect_works' when replied then 'list' else coalesce(rule, 'unknown') end as question_type,
    case when {MULTI} then 2 when rule in ({', '.join(map(R.squote, V.PROPERTY_RELATION_NAMES))}) then 1 when replied then 3 else 1 end as reasoning_depth from q""")
def semantic_parse_model(spark, sf_dir):
    """Questions with a model's replies, of which some aren't JSON."""
    k = F.substring("qid", 2, 20).cast("int") % 4
    asked = questions(spark, sf_dir).withColumn("llm_json", F.when(k == 0, REPLY).when(k == 1, "I am not sure.").when(k == 2, '{"relations":[]}'))
    return qa.parse(asked).select("qid", F.array_join("relations", ",").alias("relations"), "question_type", "reasoning_depth")


@query(f"""with {R.NODES}, {R.EDGES}, d as (select id, label, 'Chi tiết về [' || label || ']: id: ' || id || '; label: ' || label || case when type = 'E74_Group' then '' else '; type: ' || type end || case when type = 'E53_Place' then '; listed: ' || id || ', x' else '' end as detail from nodes),
    e as (select * from edges where relation like 'P53%')
    select 'Fact: ' || coalesce(s.label, 'Unknown') || ' có mối quan hệ ' || chr(39) || replace(replace(relation, 'P53_', ''), '_', ' ') || chr(39) || ' với ' || coalesce(t.label, 'Unknown') as fact from e left join d s on s.id = source left join d t on t.id = target
    union select detail from d where id in (select source from e union select target from e)""")
def evidence_details(spark, sf_dir):
    nodes = graph.star_nodes(spark, sf_dir)
    listed = F.when(F.col("type") == "E53_Place", F.array("id", F.lit("x"))).otherwise(F.array().cast("array<string>"))
    nodes = nodes.select("id", "label", F.when(F.col("type") == "E74_Group", "").otherwise(F.col("type")).alias("type"), listed.alias("listed"))
    return qa.evidence_of(graph.star_edges(spark, sf_dir).where("relation like 'P53%'"), nodes)


# Streams


@query("select user_id, event_type, arg_max(value, event_id) as value, max(event_id) as event_id from events group by all")
def stream_upsert(spark, sf_dir):
    return upserts.upsert_stream(spark, f"{sf_dir}/events.parquet", ["user_id", "event_type"], "event_id", ["user_id", "event_type", "value", "event_id"])
