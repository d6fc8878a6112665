"""Every registered graph query against its SQL, on small tables where they are at hand."""

import os
import random

import pytest

import __spark_entry__ as entry
from terrane.functions import similarity
from terrane.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark".split()


def text(x):
    try:
        if x is None or x != x:
            return "NULL"
    except (TypeError, ValueError):
        pass
    return repr(round(x, 6)) if isinstance(x, float) else str(x)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = con.execute(plans.SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert sorted([text(r[c]) for c in columns] for r in df.collect()) == sorted([text(r[i]) for i in order] for r in expected.fetchall())


def embeddings(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def cosine(a, b):
    norms = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    return sum(x * y for x, y in zip(a, b, strict=True)) / norms if norms else None


def test_target_scores_cover_all_rows(spark, tmp_path):
    """Labels that only ids from 10 on have, a null label and a vector without direction have rows, too."""
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)], None if i == 29 else i // 10) for i in range(30)] + [(30, [0.0] * 4, 1)]
    got = {r.vec_id: r.value for r in plans.QUERIES["path_target_score"](spark, embeddings(spark, tmp_path, rows)).collect()}
    mean = {}
    for of in (0, 1, 2):
        own = [v for _, v, label in rows if label == of]
        mean[of] = [sum(x) / len(own) for x in zip(*own, strict=True)]
    assert set(got) == {i for i, *_ in rows}
    for i, v, label in rows:
        assert abs(got[i] - (0 if label is None else cosine(v, mean[label]) or 0)) < 1e-4


@pytest.mark.parametrize("most", [2048, 2])
def test_nearest_are_of_any_label(spark, tmp_path, most):
    """A query's nearest have other labels, or it has none; equal vectors go by id, one without direction is no neighbour."""
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)], None if i % 40 == 0 else i % 20) for i in range(100)] + [(100, [0.0] * 3, 1), (None, [1.0] * 3, 1), (101, None, 1)]
    where = embeddings(spark, tmp_path, rows)
    if most == 2048:
        out = plans.QUERIES["cosine_topk"](spark, where)
    else:
        e = spark.read.parquet(f"{where}/embeddings.parquet")
        out = similarity.nearest(e, e.where("vec_id % 20 = 0"), most_queries=most)
    got = {}
    for r in out.orderBy("q", "place").collect():
        got.setdefault(r.q, []).append((r.id, round(r.cosine, 4)))
    usable = [(i, v) for i, v, _ in rows if i is not None and v and any(v)]
    for q, v in usable:
        if q % 20 == 0:
            best = sorted((-round(cosine(v, w), 9), i) for i, w in usable if i != q)[:5]
            assert got.pop(q) == [(i, pytest.approx(-c, abs=1e-4)) for c, i in best]
    assert not got


def test_entry_has_queries():
    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
