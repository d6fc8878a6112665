"""The beam search and the answers made from it in DuckDB's SQL, a depth at a time."""

from __future__ import annotations

from collections.abc import Mapping

from ..functions import vocabulary as V
from . import registry as R

RELATIONS = ["P53_has_former_or_current_location", "P14_carried_out_by", "P108_was_produced_by", "P46_is_composed_of", "P4_has_time_span"]


def keyword(text: str, groups, default: str) -> str:
    return next((name for name, words in groups if any(w in text for w in words)), default)


def similarities(requests: list[str], similar: Mapping[tuple[str, str], float] | None = None) -> str:
    """VALUES (key, relation, similarity) of what each request (names between commas) allows."""
    rows = []
    for key in requests:
        names = [n.strip().lower() for n in key.split(",") if n]
        groups = {k for n in names for k, aliases in V.RELATION_ALIASES.items() if n == k or any(a in n for a in aliases)}
        canonical = [keyword(n, V.CANONICAL_KEYWORDS, "related_to") for n in names]
        codes = {V.CIDOC_RELATIONS.get(n) or next((c for k, c in V.CIDOC_RELATIONS.items() if k in n), None) for n in names} - {None}
        for relation in RELATIONS:
            name = next((k for k, c in V.CIDOC_RELATIONS.items() if c == relation), relation.lower())
            own = keyword(name, V.CANONICAL_KEYWORDS, "related_to")
            value = 1.0 if name in groups else V.MATERIAL_SIMILARITY if "material_used" in groups else 1.0 if own in canonical else max([(similar or {}).get((own, c), 0.0) for c in canonical], default=0.0)
            if not codes or relation in codes:
                rows.append(f"('{key}', '{relation}', {value}::double)")
    return "sims(key, relation, similarity) as (values " + ", ".join(rows) + ")"


def beam(deepest: int, requests: list[str], targets: bool = False, similar: Mapping[tuple[str, str], float] | None = None) -> str:
    """CTEs up to found (qid, rank, depth, nodes, rels, labels, score), from asked (qid, root, key, beam_width, max_depth),
    labels (id, label), ways, and targets (qid, next, target) if there are any."""
    ctes = [
        similarities(requests, similar),
        "steps as (select distinct src, relation, dst from ways)",
        """b0 as (select qid, key, beam_width, max_depth, 1::bigint as rank, root as cur, [root] as nodes, []::varchar[] as rels, []::varchar[] as ends, []::double[] as ss, null::double as last_mean
            from asked join labels on id = root)""",
    ]
    for d in range(1, deepest + 1):
        ctes.append(f"""
    f{d} as (select b.*, w.relation, w.dst as next, similarity, row_number() over (partition by qid, rank order by w.relation, w.dst) as o
        from (select * from b{d - 1} where max_depth >= {d} qualify row_number() over (partition by qid, cur order by rank) = 1) b join steps w on w.src = b.cur join sims s on s.key = b.key and s.relation = w.relation
        qualify o <= 100),
    g{d} as (select *, max(similarity > {V.RELATION_FLOOR}) over (partition by qid, rank) as any_pass,
        row_number() over (partition by qid, rank order by (similarity > {V.RELATION_FLOOR}) desc, case when similarity > {V.RELATION_FLOOR} then -similarity end, o) as k from f{d}),
    h{d} as (select qid, g.key, beam_width, max_depth, rank as parent, o, next as cur, list_append(nodes, next) as nodes, list_append(rels, relation) as rels, list_append(ends, l.label) as ends, list_append(ss, similarity) as ss, last_mean
        from g{d} g join labels l on l.id = next where case when any_pass then similarity > {V.RELATION_FLOOR} and k <= {V.RELATION_KEPT} else o <= {V.RELATION_FALLBACK} end and not list_contains(nodes, next)),
    c{d} as (select * from (select h.*, round({V.RELATION_WEIGHT}::double * (list_sum(list_transform(ss, lambda x, i: x / i)) / len(ss)) + {V.STRUCTURE_WEIGHT}::double * greatest(0.0::double, 1.0::double - (len(ss) - 1) * {V.LENGTH_PENALTY}::double)
        {f"+ {V.TARGET_WEIGHT}::double * coalesce(t.target, 0)" if targets else ""}, 4) as score from h{d} h {"left join targets t on t.qid = h.qid and t.next = h.cur" if targets else ""}) where score >= {V.PATH_FLOOR}),
    r{d} as (select *, round(avg(score) over (partition by qid), 9) as mean, max(score) over (partition by qid) as most, row_number() over (partition by qid order by score desc, parent, o) as rank from c{d}),
    k{d} as (select * from r{d} where rank <= greatest({V.LEAST_BEAM}, floor(round(beam_width * mean / greatest(most, 0.1), 9)))),
    b{d} as (select qid, key, beam_width, max_depth, rank, cur, nodes, rels, ends, ss, mean as last_mean from k{d} where most <= {V.STOP_SCORE} and not (last_mean is not null and mean < round({V.STOP_DROP}::double * last_mean, 9)))""")
    every = " union all ".join(f"select qid, {d} as depth, rank as place, nodes, rels, ends, score from k{d}" for d in range(1, deepest + 1))
    ctes.append(f"found as (select *, row_number() over (partition by qid order by score desc, depth, place)::int as rank from ({every}))")
    return ",\n".join(ctes)


def suppliers(relations: str, width: int, depth: int) -> str:
    """CTEs of a search from all suppliers."""
    asked = f"asked as (select 'S' || s_suppkey as qid, 'S' || s_suppkey as root, '{relations}' as key, {width} as beam_width, {depth} as max_depth from supplier), labels as (select id, label from nodes)"
    return f"with {R.NODES}, {R.EDGES}, {R.WAYS}, {asked}, {beam(depth, [relations])}"


#: Distinct answers of found, each question's in order; needs kinds (qid, question_type, root_label).
ANSWERS = """
given as (select f.qid, rank, 1 as pos, ends[1] as answer, rels[1] as relation, score from found f join kinds q on q.qid = f.qid where question_type = 'architect_works' and len(ends) > 1 and ends[-1] != root_label
    union all select f.qid, rank, 2, ends[-1], rels[-1], score from found f join kinds q on q.qid = f.qid where question_type != 'architect_works' or (len(ends) > 1 and ends[-1] != root_label)),
once as (select * from given qualify row_number() over (partition by qid, answer order by rank, pos) = 1),
answers as (select *, row_number() over (partition by qid order by rank, pos) - 1 as place from once),
bests as (select f.qid, arg_min(ends[-1], rank) as best from found f join kinds q on q.qid = f.qid where question_type != 'architect_works' or len(ends) > 1 group by 1)"""

KEYS = ["", "architect", "architect,built_by", "located_in", "coordinates", "description", "address", "country", "material_used"]


def questions(multi: str, asks: str, questions_cte: str) -> str:
    """CTEs from the questions about suppliers and nations to answers and bests."""
    kinds = "('E74_Group', 'E53_Place', 'E22_Human-Made_Object')"
    return f"""with {R.NODES}, {R.EDGES}, {R.WAYS}, {questions_cte}, labels as (select id, label from nodes where type in {kinds}),
    parsed as (select qid, question, case when {multi} then 'architect,built_by' else coalesce({asks}, '') end as key, case when {multi} then 'architect_works' else coalesce({asks}, 'unknown') end as question_type,
        case when {multi} then 8 else 5 end as beam_width, case when {multi} then 3 else 2 end as max_depth from questions),
    normal as (select id, label, {R.norm_link("label")} as n from labels), asking as (select qid, {R.norm_link("question")} as n from questions),
    roots as (select qid, arg_min(struct_pack(id := id, label := label), struct_pack(l := -length(label), id := id)) as r from asking a join normal l on l.n != '' and contains(a.n, l.n) group by 1),
    kinds as (select p.*, r.id as root, r.label as root_label from parsed p left join roots r on r.qid = p.qid),
    asked as (select qid, root, key, beam_width, max_depth from kinds where root is not null), {beam(3, KEYS)}, {ANSWERS}"""


FINAL = f"""
lists as (select qid, count(*) as n, string_agg(answer, ', ' order by place) as many, arg_min(answer, place) as one, arg_min(answer, place) filter (relation in ('P14_carried_out_by', 'architect')) as who,
    string_agg(answer, ', ' order by place) filter (relation not in ('P14_carried_out_by', 'architect')) as what from answers group by 1),
whole as (select k.*, coalesce(n, 0) as n, many, one, who, what, best from kinds k left join lists l on l.qid = k.qid left join bests b on b.qid = k.qid)
select qid, question, question_type, root, case when root is not null then 'beam_search' end as reasoning_type, case when root is null then {R.squote(V.NO_ENTITY)} end as error, case
    when root is null then null
    when question_type = 'architect_works' then case
        when who is not null and what is not null then 'Theo KG, kiến trúc sư của ' || root_label || ' là ' || who || '; các công trình do kiến trúc sư này thiết kế gồm: ' || what || '.'
        when what is not null then 'Theo KG, các công trình do kiến trúc sư của ' || root_label || ' thiết kế gồm: ' || what || '.'
        when who is not null then 'Theo KG, kiến trúc sư của ' || root_label || ' là ' || who || '.'
        when best is not null then 'Theo KG, kiến trúc sư của ' || root_label || ' là ' || best || '.'
        else 'Theo KG, không tìm thấy công trình thiết kế bởi kiến trúc sư của ' || root_label || '.' end
    when n = 0 then 'Theo KG, không tìm thấy câu trả lời phù hợp.'
    when question_type = 'architect' and n = 1 then 'Theo KG, kiến trúc sư của ' || root_label || ' là ' || one || '.'
    when question_type = 'architect' then 'Theo KG, các kiến trúc sư của ' || root_label || ' gồm: ' || many || '.'
    when question_type = 'located_in' and n = 1 then 'Theo KG, ' || root_label || ' nằm ở ' || one || '.'
    when question_type = 'located_in' then 'Theo KG, ' || root_label || ' nằm ở: ' || many || '.'
    when n = 1 then 'Theo KG, câu trả lời là ' || one || '.'
    else 'Theo KG, các câu trả lời gồm: ' || many || '.' end as final_answer from whole"""
