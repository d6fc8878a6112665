"""Ingest, refinement, graph and questions on hand-made rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from terrane.functions import similarity as S
from terrane.operators import beam, graph, ingest, qa, rank, refine
from terrane.sources import files, schemas


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("", 9, 2), (None, 9, 3)], "k string, v int, o int")
    new = spark.createDataFrame([("b", 3, 0), ("c", 4, 1), ("c", 5, 2), (None, 6, 3)], "k string, v int, o int")
    assert sorted((r.k, r.v) for r in ingest.upsert(old, new, ["k"], "o").collect()) == [("a", 1), ("b", 3), ("c", 5)]


def test_triples_fill_after_distinct(spark):
    rows = [("a", None, "b"), ("a", "related_to", "b"), ("a", "x", "b"), ("a", "x", "b"), (None, "x", "b")]
    df = spark.createDataFrame(rows, "source string, relation string, target string")
    assert sorted(r.predicate for r in ingest.triples(df).collect()) == ["related_to", "related_to", "x"]


def test_nodes_from_claims(spark, tmp_path):
    place, item = {"latitude": 1.5, "longitude": 2.0}, {"id": "Q1", "label": "đền"}
    rows = [{"entity_id": "A", "property": p, "target": t} for p, t in (("P625", place), ("P625", {"latitude": 9, "longitude": 9}), ("P31", item), ("P31", {"id": "Q2", "label": None}), ("P571", "+1955-00-00T00:00:00Z"))]
    path = tmp_path / "m.json"
    path.write_text(json.dumps(rows))
    metadata = files.read_records(spark, str(path), schemas.METADATA).withColumn("ord", F.monotonically_increasing_id())
    entities = spark.createDataFrame([("A", "x", "d"), ("B", "y", None)], "id string, label string, description string")
    a, b = sorted(ingest.build_nodes(entities, metadata).collect(), key=lambda r: r.id)
    assert (a.latitude, a.longitude, a.inception, a.ner_type, a.type) == (1.5, 2.0, "+1955-00-00T00:00:00Z", "FAC", "E27_Site")
    assert [x.id for x in a.wd_properties.instance_of] == ["Q1", "Q2"] and b.wd_properties.country == [] and b.ner_type == "UNKNOWN"
    assert files.read_records(spark, str(tmp_path / "none.json"), "a int", strict=False).count() == 0
    with pytest.raises(FileNotFoundError):
        files.read_records(spark, str(tmp_path / "none.json"), "a int")
    (tmp_path / "s.csv").write_text("﻿input_name,wikidata_id,canonical_name,aliases\nn,Q1,c,a|b\nm,Q2,c,\n", encoding="utf-8")
    assert [r.aliases for r in files.read_seeds(spark, str(tmp_path / "s.csv")).collect()] == [["a", "b"], []]


def test_relations(spark):
    rows = [("a", "P84", "b", "architect"), ("a", "P84", "b", "architect"), ("", "P1", "b", "x"), ("a", "zzz", "c", None)]
    got = ingest.map_relations(spark.createDataFrame(rows, "source string, property string, target string, relation string")).collect()
    assert sorted((r.relation, r.original_relation) for r in got) == [("P14_carried_out_by", "architect"), ("related_to", "zzz")]


def test_resolution_is_greedy_and_not_transitive(spark):
    rng = random.Random(3)
    labels = ["aaaaaaaaaa", "aaaaaaaaab", "aaaaaaaabb", "Ab cd", "cd ab", "ab  CD", "x", "", ""] + ["a" + "".join(rng.choices("ab", k=12)) for _ in range(60)]
    rows = [(f"n{i}", i, x, "T", "U" if i % 7 else "V") for i, x in enumerate(labels)]
    nodes = spark.createDataFrame(rows, "id string, ord int, label string, type string, ner_type string")
    form = lambda x: " ".join(sorted(" ".join(x.lower().split()).split()))
    key = lambda x: " ".join(x.lower().split())

    def same(p, q):
        x, y = key(p[2]), key(q[2])
        n = len(form(x)) + len(form(y))
        return p[4] == q[4] and x[:1] == y[:1] and (x == y or (n and 200 * S.common_subsequence(form(x), form(y)) / n >= 90))

    used, expected = set(), {}
    for i, p in enumerate(rows):
        if p[0] in used:
            continue
        for q in rows[i + 1 :]:
            if q[0] not in used and same(p, q):
                used.add(q[0])
                expected[q[0]] = p[0]
    assert {r.dropped: r.kept for r in refine.resolve(nodes).collect()} == expected


def test_merge_remap_time_links(spark):
    node = lambda i, o, **k: {"id": i, "ord": o, "label": f"L{i}", "latitude": None, "longitude": None, "inception": None, "address": "", "wd_properties": {"instance_of": [], "heritage_designation": [], "country": []}, **k}
    kind = "struct<instance_of:array<struct<id:string,label:string>>,heritage_designation:array<struct<id:string,label:string>>,country:array<struct<id:string,label:string>>>"
    linked = lambda *ids: {"instance_of": [{"id": i, "label": i} for i in ids], "heritage_designation": [], "country": []}
    rows = [node("a", 0, wd_properties=linked("p")), node("b", 1, latitude=2.0, inception="+1887-01-28T00:00:00Z", wd_properties=linked("q", "p")), node("c", 2, address="street")]
    nodes = spark.createDataFrame(rows, f"id string, ord int, label string, latitude double, longitude double, inception string, address string, wd_properties {kind}")
    aliases = spark.createDataFrame([("b", "a"), ("c", "a")], "dropped string, kept string")
    (a,) = refine.merge_nodes(nodes, aliases).collect()
    assert (a.id, a.label, a.latitude, a.inception, a.address, a.aliases) == ("a", "La", 2.0, "+1887-01-28T00:00:00Z", "street", ["Lb", "Lc"])
    assert [x.id for x in a.instance_of] == ["p", "q"]
    edges = spark.createDataFrame([("a", "r", "b"), ("b", "r", "x"), ("c", "r", "x")], "source string, relation string, target string")
    assert [tuple(r) for r in refine.remap_relations(edges, aliases).collect()] == [("a", "r", "x")]
    years = spark.createDataFrame([("p", "+1976-07-02T00:00:00Z"), ("q", "+1976-00-00T00:00:00Z"), ("YEAR_1976", None), ("r", "+1010-00-00T00:00:00Z")], "id string, inception string")
    assert [r.id for r in refine.temporal_nodes(years).collect()] == ["YEAR_1010"] and refine.temporal_edges(years).count() == 3
    pair = spark.createDataFrame([("a", 0, "Quảng Bình"), ("b", 1, "Quảng  bình"), ("c", 2, "Quảng Ninh")], "id string, ord int, label string")
    assert [tuple(r) for r in refine.cross_links(pair).collect()] == [("a", "b", "related_to", 100.0)]


def test_provenance(spark):
    nodes = spark.createDataFrame([("a", "An"), ("b", "Huế"), ("c", "a+b (c)"), ("d", "x"), ("e", "\\E cố")], "id string, label string")
    chunks = spark.createDataFrame([("1", "s", "Thanh huế"), ("2", "s", "an. HUẾ cố đô"), ("3", "s", "is a+b (c) so"), ("4", "s", "x")], "chunk_id string, source string, text string")
    assert sorted((r.entity_id, r.chunk_id) for r in refine.provenance(nodes, chunks).collect()) == [("a", "2"), ("b", "1"), ("b", "2"), ("c", "3")]


EDGES = "source string, relation string, target string"


def test_paths_and_reach(spark):
    edges = spark.createDataFrame([("a", "r", "b"), ("b", "r", "a"), ("b", "r", "c"), ("c", "r", "d")], EDGES)
    start = spark.createDataFrame([("a",)], "id string")
    got = {">".join(r.nodes) for r in graph.paths(start, edges, 3, directed=True).collect()}
    assert got == {"a>b", "a>b>a", "a>b>c", "a>b>c>d"}
    assert {(r.id, r.hop) for r in graph.reach(start, edges, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert graph.reach(start, edges, 3, budget=2).count() == 2
    both = graph.expand(start, edges).collect()
    assert [(r.relation, r.neighbour) for r in both] == [("r", "b")] and graph.expand(start, edges, ["z"]).count() == 0
    nodes = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    assert graph.load_edges(edges, nodes).count() == 2 and graph.repeated_ids(nodes).collect()[0].id == "b"


def test_scores(spark):
    rows = [([],), ([1.0],), ([1.0, 0.5],), ([0.1, 0.1, 0.1],)]
    df = spark.createDataFrame(rows, "s array<double>")
    got = [r[0] for r in df.select(rank.path_score(F.col("s"))).collect()]
    assert got == [0.0, 0.8, round(0.55 * 1.25 / 2 + 0.25 * 0.85, 4), round(0.55 * (0.1 + 0.05 + 0.1 / 3) / 3 + 0.25 * 0.7, 4)]


def heritage(spark):
    label = {"d": "Dinh Độc Lập", "n": "Ngô Viết Thụ", "q": "Quận 1", "v": "Việt Nam", "y": "1966", "m": "Bê tông"}
    nodes = spark.createDataFrame([(i, x, "Phủ" if i == "d" else None, [label["v"]] if i == "d" else None, 10.7 if i == "d" else None, 106.6 if i == "d" else None) for i, x in label.items()], "id string, label string, description string, country array<string>, latitude double, longitude double")
    edges = spark.createDataFrame([("d", "P14_carried_out_by", "n"), ("d", "P53_has_former_or_current_location", "q"), ("d", "P4_has_time_span", "y"), ("q", "P53_has_former_or_current_location", "v"), ("d", "P45_consists_of", "m")], EDGES)
    return nodes, edges


def test_questions(spark):
    asked = [
        ("Ai là kiến trúc sư của Dinh Độc Lập?", "Theo KG, kiến trúc sư của Dinh Độc Lập là Ngô Viết Thụ."),
        ("Dinh Độc Lập nằm ở đâu?", "Việt Nam"),
        ("Những công trình nào do kiến trúc sư của Dinh Độc Lập thiết kế?", "Theo KG, không tìm thấy công trình thiết kế bởi kiến trúc sư của Dinh Độc Lập."),
        ("Tọa độ của dinh doc lap?", None),
        ("Kinh độ của Dinh Độc Lập?", "Theo KG, tọa độ của Dinh Độc Lập là Vĩ độ: 10.7, Kinh độ: 106.6."),
        ("Dinh Độc Lập làm bằng vật liệu gì?", "Theo KG, Dinh Độc Lập được làm bằng Bê tông."),
        ("Không có gì", None),
    ]
    q = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(asked)], "qid int, question string")
    got = {r.qid: r for r in qa.answer_questions(q, *heritage(spark)).collect()}
    assert len(got) == len(asked)
    for i, (_, expected) in enumerate(asked):
        assert got[i].final_answer == expected
    assert got[6].error == "No entity found." and got[3].root is None and got[1].reasoning_type == "property_retrieval"
    assert got[0].answers[0].score == 0.8


def test_parse_keeps_a_models_reply(spark):
    rows = [(1, "gì?", '{"question_type": "list", "relations": ["part_of"], "reasoning_depth": 3}'), (2, "địa chỉ?", '{"reasoning_depth": 3}'), (3, "x", "not json"), (4, None, None)]
    got = qa.plan(qa.parse(spark.createDataFrame(rows, "qid int, question string, llm_json string"))).collect()
    assert [(r.relations, r.question_type, r.beam_width, r.max_depth) for r in got] == [(["part_of"], "list", 15, 4), (["address"], "address", 5, 2), ([], "unknown", 5, 2), ([], "unknown", 5, 2)]


def test_beams_have_no_repeated_node(spark):
    nodes = spark.createDataFrame([(f"n{i}", f"n{i}") for i in range(30)], "id string, label string")
    rng = random.Random(4)
    edges = spark.createDataFrame([(f"n{rng.randrange(30)}", rng.choice(["P14_carried_out_by", "P4_has_time_span"]), f"n{rng.randrange(30)}") for _ in range(120)], EDGES)
    q = spark.createDataFrame([(f"q{i}", f"n{i}", ["architect"] if i % 2 else [], 5, 3) for i in range(6)], "qid string, root string, relations array<string>, beam_width int, max_depth int")
    rows = beam.beam_search(q, nodes, edges).collect()
    assert rows and all(len(set(r.nodes)) == len(r.nodes) and 0.25 <= r.score <= 1 for r in rows)
    assert all(e.relation == "P14_carried_out_by" for r in rows if int(r.qid[1:]) % 2 for e in r.edges)
    per = {}
    for r in sorted(rows, key=lambda r: (r.qid, r.rank)):
        assert per.get(r.qid, 1.0) >= r.score
        per[r.qid] = r.score
    assert beam.diverse(spark.createDataFrame(rows)).count() <= len(rows)


def test_tolerant_json(spark):
    rows = spark.createDataFrame([("```json\n{\"a\": 1}\n```",), ("{\"a\": 1}",), ("oops",)], "t string")
    got = [r[0] for r in rows.select(F.to_json(files.tolerant_json(F.col("t")))).collect()]
    assert got == ['{"a":1}', '{"a":1}', None]


def test_graph_sink_and_upserts(spark, tmp_path):
    nodes, edges = heritage(spark)
    files.write_graph(nodes, edges, str(tmp_path / "g"))
    back = spark.read.parquet(str(tmp_path / "g/edges"))
    assert back.where("relation = 'P45_consists_of'").count() == 1 and back.count() == 5
    one = files.write_upserted(spark.createDataFrame([("a", 1)], "k string, v int"), str(tmp_path / "t0"), ["k"], str(tmp_path / "t1"))
    two = files.write_upserted(spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int"), str(tmp_path / "t1"), ["k"], str(tmp_path / "t2"))
    assert one.count() == 1 and sorted(tuple(r) for r in two.collect()) == [("a", 2), ("b", 3)]


def test_token_set_keys_match_the_proof(spark):
    rows = spark.createDataFrame([("b a a",), ("ab",), ("axb",), ("one two",)], "t string").select("t", S.token_set_keys(F.col("t")).alias("k")).collect()
    assert {r.t: set(r.k) for r in rows} == {
        "b a a": {"ta", "tb", "2a ", "2 b", "1a", "1 ", "1b"}, "ab": {"tab", "2ab", "1a", "1b"}, "axb": {"taxb", "2ax", "2xb", "1a", "1x", "1b"},
        "one two": {"tone", "ttwo", "2on", "2ne", "2e ", "2 t", "2tw", "2wo"},
    }


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    from terrane.streaming.upserts import upsert_stream

    write = lambda rows, at: spark.createDataFrame(rows, "k string, v int, o int").coalesce(1).write.parquet(f"{tmp_path}/in/{at}")
    write([("a", 1, 1), ("b", 1, 2)], "x=1")
    read = lambda: sorted((r.k, r.v) for r in upsert_stream(spark, f"{tmp_path}/in", ["k"], "o", ["k", "v", "o"], name=tmp_path.name).collect())
    assert read() == [("a", 1), ("b", 1)]
    write([("b", 2, 3), ("c", 2, 4)], "x=2")
    assert read() == [("a", 1), ("b", 2), ("c", 2)] == read()


def test_graph_questions_of_no_relation_read_all_edges(spark):
    edges = spark.createDataFrame([("a", "P53_has_former_or_current_location", "b"), ("a", "P46_is_composed_of", "c")], "source string, relation string, target string")
    asked = lambda *r: beam.with_requests(spark.createDataFrame([(list(r),)], "relations array<string>"))
    assert beam.requested_edges(asked("located_in"), edges).count() == 1 and beam.requested_edges(asked(), edges).count() == 2


def written_rows(spark, monkeypatch, module, run):
    """What run() returns, and the rows of each step that the module writes meanwhile."""
    rows, whole = [], module.step
    monkeypatch.setattr(module, "step", lambda df: (rows.append((out := whole(df)).count()), out)[1])
    return run(), rows


def test_beams_at_a_hub_meet_its_chosen_edges_only(spark, monkeypatch):
    """400 questions that all come to a year with 400 orders: no step has a row for each question and order."""
    n = 400
    nodes = spark.createDataFrame([(f"o{i:03}", f"o{i}") for i in range(n)] + [("y", "1998")], "id string, label string")
    edges = spark.createDataFrame([(f"o{i:03}", "P4_has_time_span", "y") for i in range(n)] * 2, EDGES)
    q = spark.createDataFrame([(f"q{i}", f"o{i:03}", ["thuộc về"], 5, 2) for i in range(n)], "qid string, root string, relations array<string>, beam_width int, max_depth int")
    joined, whole = [], beam.neighbours
    monkeypatch.setattr(beam, "neighbours", lambda *a, **k: (joined.append((out := whole(*a, **k)).groupBy("at").count().agg(F.max("count")).first()[0]), out)[1])
    got, rows = written_rows(spark, monkeypatch, beam, lambda: beam.beam_search(q, nodes, edges, similar={("related_to", "part_of"): 0.5}).collect())
    assert joined == [1, 15] and max(rows) <= 5 * n
    best = {r.qid: r for r in got if r.depth == 2 and r.nodes[2] == "o000"}
    assert len(best) == n - 1 and {r.depth for r in got} == {1, 2} and len(got) == 6 * n


def test_paths_first_by_text_go_on_alone(spark, monkeypatch):
    """A hub's 500 paths: 3 of a length go on. Texts decide: n1>... comes after n10>..., and an edge isn't taken twice."""
    edges = spark.createDataFrame([("n1", "r", f"a{i:03}") for i in range(500)] + [(f"a{i:03}", "r", f"b{i:03}") for i in range(500)] + [("n10", "r", "a499"), ("n10", "s", "a499"), ("n10", "s", "a499")], EDGES)
    start = spark.createDataFrame([("n1",), ("n10",)], "id string")
    every = sorted({">".join(r.nodes) for r in graph.paths(start, edges.distinct(), 2).collect()})
    got, rows = written_rows(spark, monkeypatch, graph, lambda: [r.path for r in graph.first_paths(start, edges, 2, 5).collect()])
    assert got == every[:5] and got[:3] == ["n10>a499", "n10>a499>b499", "n10>a499>n1"] and max(rows) <= 12


def test_many_keys_are_told_by_bits(spark):
    from terrane.plans.steps import among, marked, step

    keys = step(spark.range(0, 5000, 5).selectExpr("concat('k', id) as k"))
    rows = spark.range(5000).selectExpr("concat('k', id) as c", "id").unionByName(spark.createDataFrame([(None, -1)], "c string, id long"))
    for few in (10, 100_000):
        got = {r.id: r.m for r in marked(rows, "c", keys, "m", few).collect()}
        true = {i for i, m in got.items() if m}
        assert len(got) == 5001 and set(range(0, 5000, 5)) <= true and len(true) < 1600
        assert {r.id for r in among(rows, "c", keys, few).collect()} == true
    big = marked(rows, "c", step(spark.range(0, 100_000).selectExpr("concat('k', id) as k")), "m", 10)
    assert big.where("m and c is not null").count() == 5000


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_remapped_relations_meet_by_a_sort(spark):
    """No hash table of all relations, before or after they move; relations without a dropped end aren't looked up."""
    edges = spark.createDataFrame([("a", "r", "b"), ("b", "r", "x"), ("c", "r", "x"), ("x", "r", "y"), ("x", "r", "y"), ("x", None, "y"), (None, "r", "y")], EDGES)
    out = refine.remap_relations(edges, spark.createDataFrame([("b", "a"), ("c", "a")], "dropped string, kept string"))
    assert sorted(map(str, out.collect())) == sorted(["Row(source='a', relation='r', target='x')", "Row(source='x', relation='r', target='y')", "Row(source='x', relation=None, target='y')"])
    assert "keys=[source" not in plan_of(out)


def test_few_labels_go_to_the_texts(spark):
    nodes = spark.createDataFrame([("a", "an"), ("b", "huế cố"), ("c", "an")], "id string, label string")
    chunks = spark.createDataFrame([("1", "s", "An huế  CỐ đô"), ("1", "s", "huế"), ("2", "s", "bàn an")], "chunk_id string, source string, text string")
    few, many = refine.provenance(nodes, chunks), refine.provenance(nodes, chunks, most_labels=0)
    assert sorted(few.collect()) == sorted(many.collect()) and few.count() == 5
    assert "SortMergeJoin" not in plan_of(few)


def test_chunks_are_cut_a_few_texts_at_a_time(spark):
    from terrane.functions import text as X

    docs = spark.createDataFrame([(i, "word " * 40 * i if i else None) for i in range(9)], "doc_id long, text string").coalesce(1)
    cut = lambda n: sorted(map(tuple, X.chunks(docs, few=n).collect()))
    assert cut(1) == cut(2) == cut(64) and len(cut(2)) == sum(len(X.chunk_spans("word " * 40 * i)) for i in range(9))
