"""Text functions, similarities and mappings on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from terrane.functions import ontology as O
from terrane.functions import similarity as S
from terrane.functions import text as X


def values(spark, rows, *columns, schema="a string, b string"):
    rows = [r if isinstance(r, tuple) else (r, None) for r in rows]
    return [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").orderBy("i").select(*columns).collect()]


def test_normal_forms(spark):
    rows = ["Đền  Hùng", "Phong Nha - Kẻ Bàng", "Café\tX", None, "A_b/c!"]
    got = values(spark, rows, X.norm_lower_ws("a"), X.norm_link("a"), X.norm_legacy("a"), X.norm_cypher("a"), X.norm_ws("a"))
    assert got[0] == ("đền hùng", "đen hung", "en hung", "đền  hùng", "Đền Hùng")
    assert got[1][1] == "phong nha ke bang" and got[2][1] == "cafe x"
    assert got[3] == ("", None, None, None, None)
    assert got[4][1:4] == ("a b c", "a b c", "a b c!")
    assert values(spark, ["x[12] y [a] [cần dẫn nguồn]z", None], X.strip_citations("a")) == [("x y z",), ("",)]


def brute_chunks(t, size=800, overlap=100):
    out, start = [], 0
    while t.strip() and start < len(t):
        if start + size >= len(t):
            out.append((start, len(t)))
            break
        end = start + size
        while end > start and t[end - 1] not in " \n.,!?":
            end -= 1
        end = end if end > start else start + size
        out.append((start, end))
        start += max(1, end - start - overlap)
    return out


def test_chunks(spark):
    rng = random.Random(1)
    texts = ["", "  ", "a" * 800, "a" * 801, "b" * 2000, "c" * 730 + "." + "d" * 500, *["".join(rng.choices("abc .\n!?,é", k=rng.randrange(3000))) for _ in range(20)]]
    for t in texts:
        assert X.chunk_spans(t) == brute_chunks(t)
    rows = X.chunks(spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")).collect()
    assert len({r.chunk_id for r in rows}) == len(rows) == sum(len(brute_chunks(t)) for t in texts)


def test_pages(spark):
    long = "A paragraph that is long enough to be kept &amp; read.[3] "
    html = f"<p>{long}</p><p>short</p><script><p>{long}</p></script><table><p>{long}</p></table><div class='x navbox'><p>{long}</p></div><!-- <p>{long}</p> --><h2>One</h2><p>{long}<b>bold</b></p><h3>Tham khảo</h3><p>{long}</p>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    kept = "A paragraph that is long enough to be kept & read."
    assert [(r.page_id, r.text) for r in sorted(X.page_paragraphs(df).collect())] == [(1, kept), (1, kept + " bold"), (1, kept)]
    assert sorted((r.section, r.text) for r in X.page_sections(df).collect()) == [("Giới thiệu", kept), ("One", kept + " bold")] or sorted(r.section for r in X.page_sections(df).collect()) == ["One"]


def test_bio(spark):
    rows = [(["a", "b", "c", "d", "e", "f"], ["B-LOC", "I-LOC", "I-PER", "O", "I-PER", "B-PER"]), ([], [])]
    df = spark.createDataFrame(rows, "w array<string>, t array<string>")
    got = [[tuple(s) for s in r[0]] for r in df.select(X.bio_spans(F.col("w"), F.col("t"))).collect()]
    assert got == [[("LOC", "a b"), ("PER", "c"), ("PER", "e"), ("PER", "f")], []]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_ratios(spark):
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choices("abcé", k=rng.randrange(90))) for _ in range(2))
        assert S.common_subsequence(a, b) == lcs(a, b)
    a, b = F.col("a"), F.col("b")
    rows = [("kitten", "sitting"), ("", ""), ("b a", "a b"), ("new york", "york new city"), ("x", None), ("", "x"), ("Quảng Bình", "Quảng Ninh")]
    got = values(spark, rows, S.ratio(a, b), S.token_sort_ratio(a, b), S.token_set_ratio(a, b))
    assert got[0][0] == pytest.approx(200 * 4 / 13) and got[1][:2] == (100.0, 100.0) and got[2][1] == 100.0
    assert got[3][2] == 100.0 and got[4][0] is None and got[5][2] == 0.0 and got[6][0] == 90.0 or got[6][0] == 80.0
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in v.select(F.round(S.cosine(a, b), 4)).collect()] == [0.7071, None]


def test_mappings(spark):
    a = F.col("a")
    rows = ["built by", "built_by", "part_of", "time_span", "nằm ở", None, "Located", "P14_CARRIED_OUT_BY"]
    got = values(spark, rows, O.canonical_relation(a), O.internal_relation(a), O.relation_codes(a))
    assert [g[0] for g in got] == ["built_by", "related_to", "related_to", "related_to", "located_in", "related_to", "located_in", "related_to"]
    assert got[7][1] == "architect" and got[1][2] == "P108_was_produced_by" and got[6][2] is None
    kinds = [(["Thành phố"], False, False, "X"), ([None], False, False, "X"), ([], False, False, "X"), (["x"], True, False, "X"), (["x"], False, True, "X"), (["steel"], False, False, "X")]
    df = spark.createDataFrame(kinds, "c array<string>, d boolean, l boolean, n string")
    assert [r[0] for r in df.select(O.node_type(F.col("c"), F.col("d"), F.col("l"), F.col("n"))).collect()] == ["FAC", "X", "X", "FAC", "FAC", "MATERIAL"]
    assert values(spark, ["a-b c.d", "", None], O.safe_relation(a)) == [("a_b_c_d",), ("RELATED_TO",), ("RELATED_TO",)]
    assert values(spark, ["+1955-00-00T00:00:00Z", None], O.year_node(a)) == [("YEAR_1955",), (None,)]


def test_token_set_keys_leave_out_no_pair():
    """Every pair of short texts with a ratio of 80 or more shares a key; checked in plain Python."""
    import itertools
    import random

    from terrane.functions.similarity import common_subsequence

    def keys(text):
        own = sorted(set(text.split()))
        row = " ".join(own)
        return {f"t{t}" for t in own} | {f"2{row[i : i + 2]}" for i in range(max(1, len(row) - 1))} | ({f"1{c}" for c in row} if len(row) <= 3 else set())

    def ratio(a, b):
        x, y = set(a.split()), set(b.split())
        join = lambda s: " ".join(sorted(s))
        common, one, two = join(x & y), (join(x & y) + " " + join(x - y)).strip(), (join(x & y) + " " + join(y - x)).strip()
        if common and (x <= y or y <= x):
            return 100.0
        value = lambda p, q: 200.0 * common_subsequence(p, q) / (len(p) + len(q))
        return max([value(one, two), *([value(common, one), value(common, two)] if common else [])])

    rng = random.Random(4)
    texts = {" ".join("".join(rng.choices("abc ", k=rng.randrange(1, 12))).split()) for _ in range(400)} - {""}
    texts |= {"a bc", "a", "ab", "axb", "b a"}
    near = [(p, q) for p, q in itertools.combinations(sorted(texts), 2) if ratio(p, q) >= 80]
    assert len(near) > 500 and all(keys(p) & keys(q) for p, q in near)
