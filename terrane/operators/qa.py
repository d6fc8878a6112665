"""Questions and answers over the graph, by rules, for all questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import contains_any, first_keyword, norm_link
from ..plans.steps import step
from .beam import beam_search


def asked_relation(question: Column) -> Column:
    return first_keyword(F.trim(F.lower(F.coalesce(question, F.lit("")))), V.QUESTION_KEYWORDS, None)


def is_multi_hop(question: Column) -> Column:
    q = F.lower(F.coalesce(question, F.lit("")))
    has = lambda w: F.contains(q, F.lit(w))
    return has("công trình") & (has("kiến trúc sư của") | (has("kiến trúc sư") & has("thiết kế")))


def parse(questions: DataFrame) -> DataFrame:
    """questions (qid, question, and a model's reply as JSON in llm_json if there is one) with relations,
    question_type and depth. Rules for several hops come first; other rules fill what the reply leaves open."""
    q = questions if "llm_json" in questions.columns else questions.withColumn("llm_json", F.lit(None).cast("string"))
    reply = F.from_json("llm_json", "question_type string, relations array<string>, reasoning_depth int")
    q = q.withColumns({"__r": reply, "__rule": asked_relation(F.col("question")), "__multi": is_multi_hop(F.col("question"))})
    none = F.array().cast("array<string>")
    relations = F.when(F.size(F.coalesce("__r.relations", none)) > 0, F.col("__r.relations")).when(F.col("__rule").isNotNull(), F.array("__rule")).otherwise(none)
    kind = F.coalesce(F.nullif(F.nullif("__r.question_type", F.lit("unknown")), F.lit("")), "__rule", F.lit("unknown"))
    depth = F.when(F.col("__rule").isin(V.PROPERTY_RELATION_NAMES), 1).otherwise(F.coalesce("__r.reasoning_depth", F.lit(1)))
    multi = F.col("__multi")
    return q.select(
        *questions.columns,
        F.when(multi, F.array(F.lit("architect"), F.lit("built_by"))).otherwise(relations).alias("relations"),
        F.when(multi, "architect_works").otherwise(kind).alias("question_type"),
        F.when(multi, 2).otherwise(depth).alias("reasoning_depth"),
    )


def plan(parsed: DataFrame) -> DataFrame:
    d = F.col("reasoning_depth")
    width = F.when(d >= 3, 10).when(d >= 2, 8).otherwise(5) + F.when(F.col("question_type") == "list", 5).otherwise(0)
    return parsed.withColumns({"beam_width": width, "max_depth": F.when(d >= 3, 4).when(d >= 2, 3).otherwise(2)})


HEAD = 4


def mentions(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, id, label) of nodes whose normal label is in the normal question, word bounds or not.

    Each different question's places meet the first HEAD letters of labels; what goes on there, as long as a label that
    begins so, meets the labels. So the work follows the questions' lengths, not their squares, nor the questions' number
    times the nodes'. Empty labels match nothing.
    """
    labels = step(nodes.select("id", "label", norm_link("label").alias("norm")).where("norm != ''"))
    heads = step(labels.select(F.substring("norm", 1, HEAD).alias("head"), F.length("norm").alias("n")).distinct().groupBy("head").agg(F.collect_list("n").alias("lengths")))
    widths = sorted(r[0] for r in heads.select(F.length("head")).distinct().collect()) or [HEAD]
    asked = step(questions.select("qid", norm_link("question").alias("q")).where("q != ''"))
    at = asked.select("q").distinct().select("q", F.explode(F.sequence(F.lit(1), F.length("q"))).alias("i"))
    at = at.select("q", "i", F.explode(F.array_distinct(F.array(*[F.substring("q", F.col("i"), F.lit(w)) for w in widths]))).alias("head"))
    found = at.join(heads, "head").select("q", "i", F.explode("lengths").alias("n")).where(F.col("i") + F.col("n") - 1 <= F.length("q"))
    return found.select("q", F.substring("q", F.col("i"), F.col("n")).alias("norm")).distinct().join(labels, "norm").join(asked, "q").select("qid", "id", "label")


def named_once(nodes: DataFrame) -> DataFrame:
    """(id, label): of nodes with one normal label, the one that roots() would take of them."""
    best = F.min_by(F.struct("id", "label"), F.struct(-F.length("label"), F.col("id")))
    return nodes.groupBy(norm_link("label").alias("norm")).agg(best.alias("r")).select("r.id", "r.label")


def roots(found: DataFrame) -> DataFrame:
    """Each question's root: the mention with the longest label, of equal ones that with the least id."""
    return found.groupBy("qid").agg(F.min_by(F.struct("id", "label"), F.struct(-F.length("label"), F.col("id"))).alias("r")).select("qid", F.col("r.id").alias("root"), F.col("r.label").alias("root_label"))


def property_answer(parsed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(qid, answer, property) for questions with a root whose first relation is a property that the root has. nodes:
    id, and latitude, longitude, address, description, country (an array or a string), as far as there are."""
    have = set(nodes.columns)
    text = lambda c: F.nullif(F.trim(F.array_join(c, ", ") if dict(nodes.dtypes)[c].startswith("array") else F.col(c).cast("string")), F.lit("")) if c in have else F.lit(None).cast("string")
    place = F.concat(F.lit("Vĩ độ: "), F.col("latitude").cast("string"), F.lit(", Kinh độ: "), F.col("longitude").cast("string")) if {"latitude", "longitude"} <= have else F.lit(None).cast("string")
    values = {
        "coordinates": place,
        "address": F.coalesce(text("address"), text("location_address")),
        "description": F.coalesce(text("description"), text("summary"), text("comment")),
        "country": F.coalesce(text("country"), text("nation")),
        "location": F.coalesce(text("location"), text("city"), text("province"), text("country"), text("address")),
    }
    own = nodes.select(F.col("id").alias("root"), *[v.alias(f"__{k}") for k, v in values.items()])
    asked = F.lower(F.coalesce(F.try_element_at("relations", F.lit(1)), F.col("question_type"), F.lit("")))
    rows = parsed.join(own, "root").withColumn("__asked", asked)
    hit = lambda k, words: contains_any(F.col("__asked"), words) & F.col(f"__{k}").isNotNull()
    answer, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, words in reversed(V.PROPERTY_KEYWORDS):
        answer, name = F.when(hit(k, words), F.col(f"__{k}")).otherwise(answer), F.when(hit(k, words), k).otherwise(name)
    return rows.select("qid", answer.alias("answer"), name.alias("property")).where("answer is not null")


def property_sentence(asked: Column, label: Column, answer: Column) -> Column:
    low = F.lower(asked)
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return (
        F.when(contains_any(low, ["coordinates", "tọa độ"]), say("Theo KG, tọa độ của ", label, " là ", answer, "."))
        .when(contains_any(low, ["address", "địa chỉ"]), say("Theo KG, ", label, " có địa chỉ: ", answer, "."))
        .when(contains_any(low, ["description", "mô tả", "thông tin"]), say("Theo KG, thông tin về ", label, ": ", answer, "."))
        .when(contains_any(low, ["country", "nước", "quốc gia"]), say("Theo KG, ", label, " thuộc ", answer, "."))
        .otherwise(answer)
    )


def answers(paths: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, answers, best): distinct answers in the order of the paths, each {answer, relation, score}; best is the last
    target of the first path. Questions about an architect's works take paths of several edges only, that don't end at
    the root, and both ends of each. A question's paths are as many as its beams at most."""
    works = F.col("question_type") == "architect_works"
    rows = paths.join(asked.select("qid", "question_type", "root_label"), "qid")
    one = lambda e: F.struct(e.target_label.alias("answer"), e.relation.alias("relation"), F.col("score").alias("score"))
    first, last, n = F.element_at("edges", 1), F.element_at("edges", -1), F.size("edges")
    given = F.when(works & (n > 1) & (last.target_label != F.col("root_label")), F.array(one(first), one(last))).when(~works, F.array(one(last))).otherwise(F.array().cast("array<struct<answer:string,relation:string,score:double>>"))
    best = F.when(~works | (n > 1), last.target_label)
    rows = rows.select("qid", "rank", given.alias("given"), best.alias("best"))
    both = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "given"))).alias("all"), F.min_by("best", F.when(F.col("best").isNotNull(), F.col("rank"))).alias("best"))
    flat = F.flatten(F.transform("all", lambda x: x.given))
    distinct = F.aggregate(flat, F.array().cast("array<struct<answer:string,relation:string,score:double>>"), lambda acc, x: F.when(F.exists(acc, lambda y: y.answer.eqNullSafe(x.answer)), acc).otherwise(F.concat(acc, F.array(x))))
    return both.select("qid", distinct.alias("answers"), "best")


def sentence(kind: Column, label: Column, found: Column, best: Column) -> Column:
    """The final sentence from the answers ({answer, relation, score})."""
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    texts = F.array_distinct(F.transform(found, lambda a: a.answer))
    many, one, n = F.array_join(texts, ", "), F.element_at(texts, 1), F.size(texts)
    names = F.transform(found, lambda a: F.lower(a.relation))
    is_architect = lambda a: a.relation.isin("P14_carried_out_by", "architect")
    architects = F.filter(found, is_architect)
    works = F.array_distinct(F.transform(F.filter(found, lambda a: ~is_architect(a)), lambda a: a.answer))
    who, what = F.try_element_at(architects, F.lit(1)).answer, F.array_join(works, ", ")
    of = say("Theo KG, kiến trúc sư của ", label, " là ")
    about_works = (
        F.when((F.size(architects) > 0) & (F.size(works) > 0), say(of, who, "; các công trình do kiến trúc sư này thiết kế gồm: ", what, "."))
        .when(F.size(works) > 0, say("Theo KG, các công trình do kiến trúc sư của ", label, " thiết kế gồm: ", what, "."))
        .when(F.size(architects) > 0, say(of, who, "."))
        .when(best.isNotNull(), say(of, best, "."))
        .otherwise(say("Theo KG, không tìm thấy công trình thiết kế bởi kiến trúc sư của ", label, "."))
    )
    either = lambda single, several: F.when(n == 1, single).otherwise(several)
    placed = (kind == "located_in") | F.arrays_overlap(names, F.array(F.lit("located_in"), F.lit("location")))
    made = (kind == "material_used") | F.array_contains(names, F.lit("material_used"))
    by_kind = (
        F.when(kind == "architect", either(say(of, one, "."), say("Theo KG, các kiến trúc sư của ", label, " gồm: ", many, ".")))
        .when(kind.isin("built_by", "founded_by"), either(say("Theo KG, ", label, " được xây dựng bởi ", one, "."), say("Theo KG, ", label, " được xây dựng bởi: ", many, ".")))
        .when(placed, either(say("Theo KG, ", label, " nằm ở ", one, "."), say("Theo KG, ", label, " nằm ở: ", many, ".")))
        .when(made, either(say("Theo KG, ", label, " được làm bằng ", one, "."), say("Theo KG, ", label, " được làm bằng: ", many, ".")))
        .otherwise(either(say("Theo KG, câu trả lời là ", one, "."), say("Theo KG, các câu trả lời gồm: ", many, ".")))
    )
    return F.when(kind == "architect_works", about_works).when(n > 0, by_kind).otherwise("Theo KG, không tìm thấy câu trả lời phù hợp.")


def answer_questions(questions: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, question, question_type, root, reasoning_type, answers, final_answer, error) for every question."""
    parsed = step(plan(parse(questions)).join(roots(mentions(questions, named_once(nodes))), "qid", "left"))
    rooted = parsed.where("root is not null")
    direct = property_answer(rooted, nodes)
    searched = rooted.join(direct, "qid", "left_anti")
    found = beam_search(searched.select("qid", "root", "relations", "beam_width", "max_depth"), nodes, edges)
    listed = answers(found, searched)
    rows = parsed.join(direct, "qid", "left").join(listed, "qid", "left")
    none = F.array().cast("array<struct<answer:string,relation:string,score:double>>")
    asked = F.coalesce(F.try_element_at("relations", F.lit(1)), "question_type")
    final = F.when(F.col("root").isNotNull(), F.when(F.col("answer").isNotNull(), property_sentence(asked, F.col("root_label"), F.col("answer"))).otherwise(sentence(F.col("question_type"), F.col("root_label"), F.coalesce("answers", none), F.col("best"))))
    how = F.when(F.col("answer").isNotNull(), "property_retrieval").when(F.col("root").isNotNull(), "beam_search")
    return rows.select("qid", "question", "question_type", "root", how.alias("reasoning_type"), F.coalesce("answers", none).alias("answers"), final.alias("final_answer"), F.when(F.col("root").isNull(), V.NO_ENTITY).alias("error"))


def evidence(rows: DataFrame) -> Column:
    """A sentence for an edge (source_label, relation, target_label)."""
    kind = F.replace(F.replace(F.col("relation"), F.lit("P53_"), F.lit("")), F.lit("_"), F.lit(" "))
    return F.concat(F.lit("Fact: "), F.coalesce("source_label", F.lit("Unknown")), F.lit(" có mối quan hệ '"), kind, F.lit("' với "), F.coalesce("target_label", F.lit("Unknown")))


def evidence_details(nodes: DataFrame) -> Column:
    """A sentence for a node: its properties (label first, null and empty ones left out, arrays joined by commas)."""
    have = dict(nodes.dtypes)
    text = lambda c: F.array_join(c, ", ") if have[c].startswith("array") else F.col(c).cast("string")
    parts = [F.concat(F.lit(f"{c}: "), F.nullif(text(c), F.lit(""))) for c in nodes.columns]
    return F.concat(F.lit("Chi tiết về ["), F.coalesce("label", F.lit("None")), F.lit("]: "), F.concat_ws("; ", *parts))


def evidence_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(fact): each edge's sentence and those of its ends, once each. Ends that are no nodes have none."""
    own = nodes.select("id", "label", evidence_details(nodes).alias("detail"))
    s, t = (own.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"), F.col("detail").alias(f"{end}_detail")) for end in ("source", "target"))
    rows = edges.join(s, "source", "left").join(t, "target", "left")
    return rows.select(F.explode(F.array_compact(F.array(evidence(rows), "source_detail", "target_detail"))).alias("fact")).distinct()
