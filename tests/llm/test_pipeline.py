"""The pipeline on planted documents, each stage against brute force."""

import random

import corpus_pipeline


def words(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    items = [words(rng, 30) for _ in range(3)]
    passage = words(rng, 80)
    texts, toxic = [], set()
    for i in range(400):
        t = words(rng, rng.randrange(30, 80))
        if i % 8 == 0:
            t, _ = t + " nasty " + words(rng, 5) + " awful", toxic.add(i)
        texts.append(t)
    near = {400: texts[1] + " end", 401: texts[2], 402: texts[2]}
    leaks = {403: words(rng, 10) + " " + items[0] + " " + words(rng, 10)}
    shared = {404: passage + " " + words(rng, 20), 405: words(rng, 20) + " " + passage}
    rest = {406: "", 407: None, 408: words(rng, 5000)}
    for more in (near, leaks, shared, rest):
        texts += list(more.values())
    sf = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        if k < 4:
            assert docs.schema.names == ["doc_id", "text", "lang", "source", "n_chars"]
            seen.append({r.doc_id: r.text for r in docs.collect()})
    assert set(seen[0]) == set(range(len(texts))) - toxic
    gone, order = set(), sorted(seen[0])
    sets = {i: shingles(seen[0][i]) for i in order}
    for i in order:
        for j in order:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                gone.add(i)
    assert gone >= set(near) and set(seen[1]) == set(seen[0]) - gone
    found = set()
    for i in sorted(seen[1]):
        b = (seen[1][i] or "").encode()
        marks = bytearray(len(b))
        for j in range(len(b) - 99):
            if b[j : j + 100] in found:
                marks[j : j + 100] = b"\1" * 100
            found.add(b[j : j + 100])
        kept = bytes(x for x, m in zip(b, marks, strict=True) if not m).decode()
        assert (seen[2][i] or "") == kept
    assert len(seen[2][405]) < 200 < len(seen[2][404])
    assert set(seen[3]) == set(seen[2]) - set(leaks)
    packed = docs.collect()
    assert {r.doc_id for r in packed} == set(seen[3])
    again = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in again.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_stages_on_odd_tables(spark, tmp_path):
    """Null ids, repeated rows, nulls in any column, clashing names, empty tables."""
    rng = random.Random(2)
    long = words(rng, 60)
    rows = [(1, long), (1, long), (2, long + " end"), (None, words(rng, 40)), (3, None), (3, None), (4, ""), (5, words(rng, 9000)), (6, words(rng, 50)), (None, None)]
    rows.append(rows[3])
    extra = "lang string, source string, n_chars long, score string, spans string, matches string, doc string, turn string, digest string"
    docs = spark.createDataFrame([(i, t, None, None, None, *"abcdef") for i, t in rows], f"doc_id long, text string, {extra}").repartition(3)
    sf = str(tmp_path)
    spark.createDataFrame([(i, 1, int(i == 6)) for i in range(7)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(0, rows[8][1]), (None, None), (1, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    expected = [[1, 1, 2, 3, 3, 4, 5, 6, -1, -1, -1], [1, 3, 4, 5, 6, -1, -1], [1, 3, 4, 5, 6, -1, -1], [1, 3, 4, 5, -1, -1], [1, 3, 4, 5, -1, -1]]
    empty = docs.limit(0)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        stage(spark, docs, sf).write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        got = docs.collect()
        if k < 4:
            assert sorted(-1 if r.doc_id is None else r.doc_id for r in got) == sorted(expected[k])
            assert docs.columns == columns and {(r.score, r.spans, r.matches, r.doc, r.turn, r.digest) for r in got} == {tuple("abcdef")}
        else:
            assert sorted(-1 if r.doc_id is None else r.doc_id for r in got if r.piece == 0) == sorted(expected[k])
        assert stage(spark, empty, sf).count() == 0
