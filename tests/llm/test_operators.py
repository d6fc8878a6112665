"""Each operator against brute force on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, more columns."""

import base64
import collections
import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import chat, decontaminate, embeddings, minhash, packing, quality, queries, suffix, toxicity, urls, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS).repartition(3)


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


# Packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_encoder_gives_the_tokenizers_ids(tokenizer):
    rng, encoder = random.Random(1), packing.Encoder(queries.tokenizer_path())
    letters = [chr(i) for i in range(0x180)] + list("  ​　 ̀'sll\n\n\t\x1c\x85Р中")
    texts = ["".join(rng.choices(letters, k=rng.randrange(30))) for _ in range(2000)]
    for t in [*texts, "", " " * 50_000, "a" * 20_000, "<|endoftext|>x"]:
        assert encoder.ids(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_packing(spark, tokenizer):
    rng = random.Random(2)
    texts = [None, "", "one", words(rng, 3000), *[words(rng, rng.randrange(1, 250)) for _ in range(150)]]
    docs = docs_of(spark, texts)
    docs = docs.union(docs.where("doc_id = 2"))
    rows = packing.pack_documents(docs, queries.tokenizer_path(), max_len=128, keep_ids=True).collect()
    per_doc, per_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        per_doc[r.doc_id].append(r)
        per_sequence[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
    assert len(per_doc[2]) == 2
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        own = sorted(per_doc[i], key=lambda r: r.piece)[: None if i != 2 else 1]
        assert [x for r in own for x in r.ids] == ids
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert all(r.length == 128 for r in own[1:])
    for own in per_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= 128
    total = sum(r.length for r in rows)
    assert len(per_sequence) <= 1.03 * total / 128 + 1
    assert packing.pack_documents(docs.limit(0), queries.tokenizer_path()).count() == 0


def test_packing_merges_over_rounds(spark):
    rng = random.Random(3)
    sizes = [rng.randrange(1, 100) for _ in range(400)]
    pieces = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "uid long, length long").repartition(20)
    rows = packing.pack(pieces, capacity=100, slack=2, fan_in=3).collect()
    fill = collections.Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert len(rows) == 400 and max(fill.values()) <= 100 and len(fill) <= 1.15 * sum(sizes) / 100 + 1


# MinHash


def components_of(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in linked:
        p, q = find(i), find(j)
        root[max(p, q)] = min(p, q)
    return [find(i) for i in range(n)]


def test_minhash_components(spark):
    rng = random.Random(4)
    base = words(rng, 120).split()
    texts = [None, "", " \t ", "A b", "a  B", words(rng, 50)]
    for _ in range(120):  # one large group, of which not all are linked with all
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    for _ in range(30):
        t = words(rng, rng.randrange(1, 60))
        texts += [t, t + " more"]
    texts.append(words(rng, 30_000))

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())

    sets = [shingles(t) for t in texts]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    expected = components_of(len(texts), linked)
    docs = docs_of(spark, texts)
    rows = minhash.near_duplicates(docs.union(docs.where("doc_id = 5")), k=4, block=8).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), expected[r.doc_id], expected[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_least_matches_is_a_posterior_bound():
    rng = np.random.default_rng(5)
    draws = rng.random(2_000_00)
    for n, m in ((16, minhash.least_matches(16, 0.8, 1e-2)), (64, minhash.least_matches(64, 0.8, 1e-2))):
        for k, above in ((m, True), (m - 1, False)):
            hits = draws[rng.binomial(n, draws) == k]
            assert ((hits >= 0.8).mean() >= 0.008) == above


# Suffixes


def brute_repeats(texts, length):
    seen, out = set(), {}
    for i, t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if b[j : j + length] in seen:
                gone[j : j + length] = b"\1" * length
            seen.add(b[j : j + length])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("most_bytes", [300, suffix.MOST_BYTES])
def test_repeated_strings(spark, most_bytes, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(suffix.repeated_spans, "__defaults__", (100, most_bytes))
    shared = [words(rng, 30), words(rng, 60), "é" * 90 + words(rng, 20)]
    texts = [None, "", "short", "ab" * 300, "x" * 5000, "same line of text here\n" * 40]
    for _ in range(60):
        t = words(rng, rng.randrange(1, 80))
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            t += " " + s[rng.randrange(20) :] + words(rng, rng.randrange(20))
        texts.append(t)
    texts += [texts[10], texts[11], "y" + texts[12], words(rng, 20_000)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(docs_of(spark, texts)).collect()}
    assert got == brute_repeats(list(enumerate(texts)), 100)


def test_repeats_on_odd_tables(spark):
    assert suffix.remove_repeats(docs_of(spark, []).limit(0)).count() == 0
    long = words(random.Random(7), 100)
    rows = spark.createDataFrame([(1, long, 0), (1, long, 0), (None, long, 0)], "doc_id long, text string, spans int")
    got = sorted((r.doc_id or 9, r.n_removed) for r in suffix.remove_repeats(rows).collect())
    assert got == [(1, 0), (1, 0), (9, len(long))]
    left = suffix.without_repeats(docs_of(spark, [long + " é", long, "", None, long + " ü and"])).collect()
    assert {r.doc_id: r.text for r in left} == {0: long + " é", 2: "", 3: None, 4: " and"}
    assert all(r.n_chars == len(r.text) for r in left if r.text is not None)


@pytest.mark.parametrize("most_bytes", [300, suffix.MOST_BYTES])
def test_repeats_of_null_and_repeated_ids(spark, most_bytes, monkeypatch):
    """Rows of one id, or of none, that share only a part with each other or with other documents."""
    monkeypatch.setattr(suffix.repeated_spans, "__defaults__", (100, most_bytes))
    rng = random.Random(60)
    shared = [words(rng, 40), words(rng, 30)]
    rows = [(rng.choice([1, 2, 3, None, None, 50 + i]), " ".join((words(rng, rng.randrange(9)), rng.choice(shared), words(rng, rng.randrange(9))))) for i in range(40)]
    rows += [rows[0], rows[7], (None, None), (1, ""), (2, shared[0][:30])]
    schema = "doc_id long, text string, spans int, spans_ int, doc string, turn string, n_chars int"
    df = spark.createDataFrame([(i, t, 1, 2, "d", "t", len(t or "")) for i, t in rows], schema).repartition(3)
    place = {(r.doc_id, r.text or ""): (r.doc, r.turn) for r in df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), suffix.place_columns()[0].alias("doc"), suffix.place_columns()[1].alias("turn")).collect()}
    order = sorted(place, key=place.get)
    expected = dict(zip(order, brute_repeats([(k, t) for k, (_, t) in enumerate(order)], 100).values(), strict=True))
    got = suffix.remove_repeats(df).join(df.select("doc_id", "text").limit(0), ["doc_id"], "left").drop("text").collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == collections.Counter((i, *expected[i, t or ""]) for i, t in rows)
    assert sum(r.n_removed > 0 for r in got) > 20 and all(r.n_removed <= r.n_bytes for r in got)
    left = suffix.without_repeats(df)
    assert left.columns == df.columns and {(r.spans, r.spans_, r.doc, r.turn) for r in left.collect()} == {(1, 2, "d", "t")}
    assert left.count() == sum(not expected[i, t or ""][1] or expected[i, t or ""][1] < expected[i, t or ""][0] for i, t in rows)


def test_transform_marks_repeats():
    rng = random.Random(8)
    for _ in range(10):
        parts = [bytes(rng.choices(b"abcd ", k=rng.randrange(300))) for _ in range(5)]
        pieces = [b"".join(rng.choices(parts, k=rng.randrange(4))) for _ in range(9)]
        marks, at, seen = suffix.repeated_starts(pieces, 50), 0, set()
        for p in pieces:
            for j in range(len(p) - 49):
                assert marks[at + j] == (p[j : j + 50] in seen)
                seen.add(p[j : j + 50])
            at += len(p) + 1


# Decontamination


def plain(t):
    return [w for w in (re.sub(r"[\W_]+", "", x.lower()) for x in (t or "").split()) if w]


def multiset(w):
    return collections.Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)])


def test_decontamination(spark):
    rng = random.Random(9)
    items = [words(rng, n) for n in (3, 5, 12, 30, 30, 55)] + [None, "", "...", "zz zz zz zz zz zz zz zz zz zz zz"]
    texts = [None, "", words(rng, 40)]
    for _ in range(60):
        w = (items[rng.randrange(6)] or "").split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = "changed"
        texts.append(words(rng, rng.randrange(20)) + " " + " ".join(x.upper() + "," for x in w) + " " + words(rng, rng.randrange(20)))
    texts += ["zz " * 30, words(rng, 10_000) + " " + items[3]]
    benchmark = spark.createDataFrame([*enumerate(items), (3, items[3]), (None, "a b c d e f")], "item_id long, text string")
    for blocks in (4096, 2):
        rows = decontaminate.with_matches(docs_of(spark, texts), benchmark, most_items=blocks).collect()
        assert len(rows) == len(texts)
        for r in rows:
            w, expected = plain(r.text), set()
            for i, item in enumerate(items):
                y = plain(item)
                best = max((sum((multiset(w[p : p + len(y)]) & multiset(y)).values()) / sum((multiset(w[p : p + len(y)]) | multiset(y)).values()) for p in range(len(w) - len(y) + 1)), default=0) if y else 0
                expected |= {i} if best >= 0.8 else set()
            assert {m.item_id for m in r.matches} == expected
    assert decontaminate.with_matches(docs_of(spark, texts), benchmark.limit(0)).where(decontaminate.clean()).count() == len(texts)


def test_decontamination_of_texts_shorter_than_items(spark):
    """Items less their first or last words, some with changed words: the whole text is the window."""
    rng = random.Random(90)
    items = [words(rng, n) for n in (2, 4, 5, 9, 13, 30, 50, 55)] + ["zz " * 20]
    texts = ["", "zz " * 17, "zz " * 3]
    for item in items:
        y = item.split()
        for cut in range(len(y)):
            w = y[:-cut or None] if cut % 2 else y[cut:]
            texts.append(" ".join(w))
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    benchmark = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    cut_short = 0
    for r in decontaminate.with_matches(docs_of(spark, texts), benchmark).collect():
        w, expected = plain(r.text), {}
        for i, item in enumerate(items):
            y = plain(item)
            k = min(5, len(y))
            shingles = lambda of: collections.Counter(tuple(of[p : p + k]) for p in range(len(of) - k + 1))  # noqa: E731, B023
            windows = [w[p : p + len(y)] for p in range(max(1, len(w) - len(y) + 1))]
            best = max(sum((shingles(x) & shingles(y)).values()) / sum((shingles(x) | shingles(y)).values()) for x in windows)
            if best >= 0.8:
                expected[i] = best
                cut_short += len(w) < len(y)
        assert {m.item_id: m.similarity for m in r.matches} == pytest.approx(expected)
        assert all(m.start + m.words <= len(w) for m in r.matches)
    assert cut_short > 20


def test_multi_index_blocks_select():
    """Few windows of random words pass the blocks; all fingerprints within the radius do."""
    rng = np.random.default_rng(91)
    s = rng.integers(0, 2**63, 30_000).astype(np.uint64)
    x = decontaminate.fingerprints(s, np.arange(20_000), 46)
    assert (x[::997] == np.concatenate([decontaminate.fingerprints(s[i : i + 46], np.zeros(1, np.int64), 46) for i in range(0, 20_000, 997)])).all()
    y = np.roll(x, 7000, axis=0)
    assert (np.bitwise_count(x ^ y) <= decontaminate.NEAR).any(axis=1).mean() < 0.05
    bits = np.unpackbits(x.view(np.uint8), axis=1)
    for row in bits:
        row[rng.choice(decontaminate.BITS, decontaminate.RADIUS, replace=False)] ^= 1
    assert len(decontaminate.within(x, np.packbits(bits, axis=1).view(np.uint32))) == len(x)


def test_decontamination_keeps_other_columns(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g", 5), (1, None, 6), (1, "x " * 9, 7)], "doc_id long, text string, matches int")
    bench = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    rows = decontaminate.with_matches(docs, bench, name="matches_").collect()
    assert sorted((r.matches, len(r.matches_)) for r in rows) == [(5, 1), (6, 0), (7, 0)]
    assert decontaminate.with_matches(docs.limit(0), bench).count() == 0


# Archives


def test_archives(spark):
    rng = random.Random(10)
    pages = [(i, f"http://h/{i}", words(rng, 30)) for i in range(40)] + [(40, None, None), (41, "http://a\nb", ""), (42, "u", "é" * 200_000), (43, "u", pages_text := "same"), (44, "u", pages_text), (45, "é", pages_text), (43, "u", pages_text)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    rows = warc.archive_and_read(df).collect()
    first = {}
    for i, _, h in sorted(pages, key=lambda p: p[0]):
        first.setdefault(h or "", i)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    expected = sorted((i, len((h or "").encode()), digest(h), "response" if first[h or ""] == i else "revisit", first[h or ""] if first[h or ""] != i else -1) for i, _, h in pages)
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in rows) == expected
    folder = warc.fresh_path(spark, "warc")
    index = warc.write_archives(df, folder, min_payload=5)
    got = {r.page_id: bytes(r.payload) for r in warc.read_records(index.where("page_id in (1, 42, 44)"), folder, payloads=True).collect()}
    assert got == {1: pages[1][2].encode(), 42: ("é" * 200_000).encode(), 44: b"same"}
    assert warc.archive_and_read(df.limit(0)).count() == 0


def test_reads_are_coalesced():
    assert warc.coalesced([(0, 10), (10, 5), (100, 5), (105, 1)], 20, 1000) == [(0, 15, [(0, 10), (10, 5)]), (100, 106, [(100, 5), (105, 1)])]
    assert len(warc.coalesced([(0, 10), (10, 10)], 20, 15)) == 2


# Embeddings


def test_embeddings(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(6, 16))
    x = np.concatenate([rng.normal(size=(300, 16)), *[c + rng.normal(size=(80, 16)) * s for c, s in zip(centres, (0.05, 0.2, 0.3, 0.4, 0.5, 0.6), strict=True)]])
    rows = [[float(v) for v in r] for r in x] + [[float(v) for v in x[5]], None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [1e300] + [0.0] * 15, [2e300] + [0.0] * 15, [], [1.0, 0.0], [2.0, 0.0]]
    df = spark.createDataFrame([(i, r, 0) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    ok = [i for i, r in enumerate(rows) if r and None not in r and np.isfinite(r).all() and any(r)]
    linked = []
    for i in ok:
        for j in ok:
            if i < j and len(rows[i]) == len(rows[j]):
                a, b = (np.array(rows[k]) / np.abs(rows[k]).max() for k in (i, j))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9:
                    linked.append((i, j))
    many = collections.Counter(k for p in linked for k in p)
    expected = components_of(len(rows), linked)
    got = embeddings.near_duplicates(df, shards=3).collect()
    assert len(got) == len(rows)
    assert sum(r.n_links for r in got) >= 0.99 * 2 * len(linked)
    assert all(r.n_links <= many[r.vec_id] for r in got)
    assert [r.component_id for r in sorted(got)] == expected
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_graph_finds_neighbours():
    x = embeddings.unit(np.random.default_rng(12).normal(size=(3000, 32)))
    graph = embeddings.Graph(x)
    ids, _ = graph.search(x[:200], 64)
    best = np.argsort(-(x[:200] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b[:64])) / 10 for a, b in zip(best, ids, strict=True)]) >= 0.9


def test_graph_alone_finds_links():
    """Recall of the graph, without audits: groups of 20, and one of 800 around one centre, in a shard of 8000."""
    rng = np.random.default_rng(120)
    centres = rng.normal(size=(360, 48))
    x = np.concatenate([c + rng.normal(size=(20, 48)) * 0.25 for c in centres] + [rng.normal(size=(1, 48)) + rng.normal(size=(800, 48)) * 0.2])
    x = embeddings.unit(x[rng.permutation(len(x))])
    graph = embeddings.Graph(x)
    assert len(graph.layers) == 3
    got = total = 0
    for i in range(0, len(x), 500):
        true = x[i : i + 500] @ x.T >= 0.9
        r, c = embeddings.linked(graph, x[i : i + 500], 0.9, 16)
        assert len(set(zip(r.tolist(), c.tolist(), strict=True))) == len(r) and true[r, c].all()
        got, total = got + len(r), total + int(true.sum())
    assert total > 300_000 and got >= 0.97 * total


def test_graph_leaves_no_node_out():
    """The narrowest beams meet every node, and every other of its group from each: audits need not widen them."""
    rng = np.random.default_rng(121)
    groups = [rng.normal(size=(1, 64)) + rng.normal(size=(n, 64)) * 0.1 for n in (150, 60, 60, 2, 2, 2)]
    x = np.concatenate([rng.normal(size=(5000, 64)), *groups])
    x = embeddings.unit(x[rng.permutation(len(x))])
    graph = embeddings.Graph(x)
    missed = 0
    for i in range(0, len(x), 500):
        q = x[i : i + 500]
        assert (graph.search(q, 16)[0] == np.arange(i, i + len(q))[:, None]).any(axis=1).all()
        missed += int((q @ x.T >= 0.9).sum()) - len(embeddings.linked(graph, q, 0.9, 16)[0])
    assert missed == 0
    assert embeddings.audited(graph, x, 0.9, 0.999, 1024) == 16


def test_graph_links_multiples():
    """Multiples of a vector are distinct classes of one direction; all meet all."""
    rng = np.random.default_rng(122)
    x = np.concatenate((rng.normal(size=(1500, 32)), rng.normal(size=(1, 32)) * rng.uniform(0.1, 10, size=(600, 1))))
    x = embeddings.unit(x[rng.permutation(len(x))])
    r, c = embeddings.linked(embeddings.Graph(x), x, 0.9, 16)
    true = x @ x.T >= 0.9
    assert true[r, c].all() and len(r) == true.sum() >= 600 * 600


# Toxicity


def test_toxicity(spark):
    rng = random.Random(13)
    texts, labels = [], []
    for i in range(900):
        w, bad = words(rng, rng.randrange(5, 80)).split(), i % 6 == 0
        if bad:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w) + 1), rng.choice(["nasty", "Awful!", "vequ" + rng.choice(["ta", "no", "rel", "mi"])]))
        texts.append(" ".join(w))
        labels.append((i, int(bad)))
    docs, table = docs_of(spark, texts), spark.createDataFrame([*labels, (0, 1), (None, 1), (5000, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, table, usable="doc_id % 3 != 1")
    more = docs_of(spark, [None, "", "nasty " + words(rng, 30_000), "so nasty awful thing"], 9000)
    rows = {r.doc_id: r for r in toxicity.score(docs.union(more), model).collect()}
    held = [(rows[i].score >= 0.7) == bool(y) for i, y in labels if i % 3 == 1]
    assert np.mean(held) >= 0.97
    assert rows[9000].score == rows[9001].score < 0.5 and not rows[9001].spans and rows[9002].score >= 0.5
    assert [rows[9003].text[s.start : s.end] for s in rows[9003].spans] == ["nasty awful"]
    none = toxicity.learn(docs, table.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("share", [0.3, 0.5, 0.7, 0.9])
def test_toxicity_at_any_base_rate(share):
    """Balanced and mostly toxic labels teach as well as rare ones do."""
    rng = random.Random(130)
    texts, toxic = [], []
    for i in range(2400):
        w, bad = words(rng, rng.randrange(5, 80)).split(), rng.random() < share
        for _ in range(rng.randrange(1, 4) if bad else 0):
            w.insert(rng.randrange(len(w) + 1), rng.choice(["nasty", "awful!", "vequ" + rng.choice(["ta", "no", "rel", "mi"])]))
        texts.append(" ".join(w))
        toxic.append(int(bad))
    model = toxicity.fit(texts[:1800], np.array(toxic[:1800]))
    evidence, *_ = toxicity.tagged([t.split() for t in texts[1800:]], model)
    score, y = model.score(evidence), np.array(toxic[1800:])
    assert model.weights and ((score >= 0.7) == y).mean() >= 0.97 and (score[y == 0] < 0.7).mean() >= 0.97


def test_chain_marginals_match_enumeration():
    rng = np.random.default_rng(14)
    model = toxicity.Model(enter=-0.7, stay_toxic=0.4, leave=0.2, stay_clean=0.9)
    lengths, e = np.array([3, 1, 5, 0, 2]), rng.normal(size=11)
    got = toxicity.marginals(toxicity.passes(np.exp(e), lengths, model))
    step, at = {(0, 1): -0.7, (1, 1): 0.4, (1, 0): 0.2, (0, 0): 0.9}, 0
    for n in lengths:
        weight = {}
        for bits in range(2**n):
            y = [bits >> k & 1 for k in range(n)]
            weight[tuple(y)] = np.exp(sum(e[at + k] * y[k] + step[(y[k - 1] if k else 0, y[k])] for k in range(n)))
        for k in range(n):
            assert abs(got[at + k] - sum(w for y, w in weight.items() if y[k]) / sum(weight.values())) < 1e-9
        at += n


def test_chains_of_whole_texts_match_enumeration():
    """Expected tokens and steps against all labellings of short texts, and observed steps against counting."""
    rng = np.random.default_rng(140)
    model = toxicity.Model(enter=-0.7, stay_toxic=0.4, leave=0.2, stay_clean=0.9)
    hit, plain = np.array([False, True, False, True, False]), 0.3
    odds_of = np.where(hit, rng.uniform(0.2, 3.0, 5), plain)
    words, toxic = [rng.integers(0, 5, n) for n in (6, 1, 0, 8, 3, 5)] + [np.array([1, 3, 1]), np.array([0, 2, 4, 0])], np.array([1, 0, 1, 1, 0, 1, 1, 1])
    chains = toxicity.Chains(words, toxic, hit)
    token = ~chains.ends
    p, rest, pairs = chains.expected(np.where(token, odds_of[np.maximum(chains.id, 0)], 1.0), plain, model)
    step = {(0, 1): model.enter, (1, 1): model.stay_toxic, (1, 0): model.leave, (0, 0): model.stay_clean}
    kinds = [(0, 1), (1, 1), (1, 0), (0, 0)]
    hits, plains, steps, seen = [], 0.0, np.zeros(4), np.zeros(4)
    for ws, t in zip(words, toxic, strict=True):
        y = [int(hit[w] and t) for w in ws]
        for k in range(len(ws)):
            seen[kinds.index((y[k - 1] if k else 0, y[k]))] += 1
        weight = {}
        for bits in range(2 ** len(ws)):
            y = [bits >> k & 1 for k in range(len(ws))]
            weight[tuple(y)] = np.exp(sum(np.log(odds_of[w]) * v + step[(y[k - 1] if k else 0, v)] for k, (w, v) in enumerate(zip(ws, y, strict=True))))
        z = sum(weight.values())
        for k, w in enumerate(ws):
            q = sum(v for y, v in weight.items() if y[k]) / z
            hits, plains = (hits + [q], plains) if hit[w] else (hits, plains + q)
            for n, kind in enumerate(kinds):
                steps[n] += sum(v for y, v in weight.items() if (y[k - 1] if k else 0, y[k]) == kind) / z
    assert sorted(p[token]) == pytest.approx(sorted(hits)) and rest == pytest.approx(plains)
    assert pairs == pytest.approx(steps) and chains.seen == pytest.approx(seen)


def test_texts_to_learn_from_are_bounded_in_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x" * (1000 if i == 3 else 10)) for i in range(9)], "doc_id long, text string")
    got = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: got.append(texts))
    for most in (10**6, 85, 0):
        toxicity.learn(docs, docs.selectExpr("doc_id", "1 as toxic"), most_bytes=most)
    assert [sorted(map(len, x)) for x in got] == [[10] * 8 + [1000], [10] * 8, []]


# Chat


def test_chat(spark):
    call = lambda *ids: json.dumps({"tool_calls": [{"id": i, "function": {"name": "add", "arguments": json.dumps({"b": 1, "a": x})}} for i, x in ids]})
    result = lambda i: json.dumps({"tool_call_id": i, "content": "3"})
    rows = [
        (1, 0, "user", "hi é\n"), (1, 1, "tool", result("c1")), (1, 2, "assistant", call(("c1", 2), ("c2", "two"))), (1, 3, "user", "then"), (1, 4, "tool", result("c2")), (1, 5, "tool", result("gone")),
        (1, 6, "assistant", call(("c1", 5))), (2, 0, "assistant", "{not json"), (2, 1, "tool", result("c1")), (2, 2, None, None), (None, None, "user", ""), (1, 3, "user", "then"), (3, 0, "user", "x" * 100_000),
    ]
    schema = {"add": {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "integer"}, "b": {"type": "integer"}}, "additionalProperties": False}}
    got = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as json"), schema)
    out = sorted(got.collect(), key=lambda r: (r.conv_id or 0, r.at_turn or 0, r.at_call, r.at_result))
    assert len(out) == len(rows)
    one = [(r.turn, r.linked, r.n_calls, r.n_valid) for r in out if r.conv_id == 1]
    assert one == [(0, None, 0, 0), (2, None, 2, 1), (1, True, 0, 0), (4, True, 0, 0), (3, None, 0, 0), (3, None, 0, 0), (5, False, 0, 0), (6, None, 1, 1)]
    assert [r.linked for r in out if r.conv_id == 2 and r.role == "tool"] == [False]
    assert out[1].json == '{"content":"hi é\\n","role":"user"}'
    assert '"arguments":{"a":2,"b":1},"id":"c1","name":"add"' in next(r.json for r in out if r.turn == 2 and r.conv_id == 1)
    assert chat.in_order(got).count() == len(rows) and chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert not chat.fits(True, {"type": "integer"}) and chat.fits([1], {"items": {"minimum": 1}}) and not chat.fits([0], {"items": {"minimum": 1}}) and not chat.fits("a", {"enum": ["b"]})


def test_chat_survives_odd_json(spark):
    call = lambda ident, arguments: json.dumps({"tool_calls": [{"id": ident, "name": "add", "arguments": arguments}]})
    deep = '{"tool_calls":' + '{"a":' * 100_000 + "1" + "}" * 100_001
    rows = [
        (1, 0, "assistant", deep), (1, 1, "assistant", '{"tool_calls":[{"id":"c\\ud800","name":"add","arguments":{"\\ue000":1,"\\ud83d\\ude00":1e2}}]}'), (1, 2, "tool", '{"tool_call_id":"c\\ud800","content":"\\udfff"}'),
        (1, 3, "assistant", call("n", '{"a": NaN}')), (1, 4, "assistant", '{"tool_calls":[{"id":"m","arguments":{"x":Infinity}}]}'), (1, 5, "assistant", call(7, {"a": 1.0})), (1, 6, "tool", '{"tool_call_id":7,"content":1.50}'),
        (1, 7, "assistant", '{"tool_calls":[' + "[" * 900 + "]" * 900 + "]}"), (1, 8, "assistant", call("d", "[" * 100_000)),
    ]
    got = {r.turn: r for r in chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {"add": {"properties": {"a": {"type": "integer"}}}}).collect()}
    assert json.loads(got[0].json)["content"] == deep and got[0].n_calls == 0
    assert got[1].json == '{"content":null,"role":"assistant","tool_calls":[{"arguments":{"\U0001f600":100,"\ue000":1},"id":"c\\\\ud800","name":"add"}]}'
    assert got[2].linked and json.loads(got[2].json)["content"] == "\udfff"
    assert (got[3].n_calls, got[3].n_valid) == (1, 0) and got[4].n_calls == 0 and json.loads(got[4].json)["content"] == rows[4][3]
    assert got[5].n_valid == 1 and '"a":1}' in got[5].json and got[6].linked and '"content":1.5,' in got[6].json and len(got) == 9 and got[8].n_valid == 0


def test_canonical_numbers_and_typed_enums():
    forms = {1e21: "1e+21", 1e20: "100000000000000000000", 1.5e300: "1.5e+300", 1e-6: "0.000001", 1.25e-7: "1.25e-7", -0.0: "0", 0.1: "0.1", -12.5: "-12.5", 123456.789: "123456.789"}
    assert {v: chat.canonical(v) for v in forms} == forms and chat.canonical(chat.loads("[1.0, 1e2, 12345678901234567890]")) == "[1,100,12345678901234567890]"
    assert not chat.fits(1, {"enum": [True]}) and not chat.fits(True, {"enum": [1]}) and chat.fits(1, {"enum": [1.0, "a"]})
    assert not chat.fits("x", {"type": "date"}) and chat.fits({"a": [1]}, {"enum": [{"a": [1]}]})


def test_chat_query_against_sql(spark, tmp_path):
    import duckdb

    rows = [(c, t, "user" if t % 2 == 0 else "assistant", None if t == 3 and c == 1 else f'é "{t}"\n' + "x" * (c * 90)) for c in range(4) for t in range(6)] + [(None, 0, "user", "hi"), (9, 0, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = [tuple(r) for r in queries.op8_chat_formatting(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, con.execute(chat.TOOLS_SQL).fetchall()))
    assert sum(r[6] for r in got) > 0 and {r[8] for r in got} == {None, True, False}


# URLs


def test_urls(spark):
    link = lambda *hosts: "".join(f'<p><a class=x href="https://{h}/p">t</a>' for h in hosts)
    pages = [
        (0, "http://A.example.org/es/1?x", ""), (1, "https://example.org/en/12", ""), (2, "http://x.com/fr/1", link("good.net")), (3, "http://x.com/de/1#f", ""), (4, "http://xcom/de/1", None), (5, None, None), (6, "no scheme", ""),
        (7, "http://y.com", ""), (8, "http://spam.net/1", link("bad.com", "bad.com", "good.net")), (9, "http://bad.com/de/9", ""), (10, "http://good.net/a", '<a href="/rel">'), (11, "http://a.org/", ""), (11, "http://a.org/", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' as host", "1 as rule")
    got = {r.page_id: r for r in urls.judge_urls(df, queries.RULES).collect()}
    expect = {0: ("example.org/es/", "block"), 1: ("example.org/en/1", "block"), 2: ("com/fr/", "allow"), 3: ("com/de/", "block"), 4: (None, "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "block"), 9: ("com/de/", "block"), 10: (None, "allow"), 11: ("org/", "allow")}
    assert {i: (r.rule, r.verdict) for i, r in got.items()} == expect
    assert (got[0].host, got[0].path) == ("a.example.org", "/es/1") and (got[6].host, got[6].path, got[5].host) == ("", "", "")
    # Distrust of bad.com, all of whose links come from spam.net, reaches it damped once.
    assert abs(got[8].distrust - 0.85) < 1e-9
    import duckdb

    con = duckdb.connect()
    con.register("pages_df", df.select("page_id", "url", "html").toPandas())
    con.execute("create view pages as select page_id, url, html from pages_df")
    rows = con.execute(urls.sql(queries.RULES)).fetchall()
    assert sorted(map(str, rows)) == sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in urls.judge_urls(df, queries.RULES).collect())


# Quality


def test_quality(spark):
    rng = random.Random(15)
    rows, labels = [], []
    for i in range(900):
        good = rng.random() < (0.9 if i % 9 else 0.2)
        t = words(rng, 60).replace("w", "word")
        rows.append((i, t if good else " ".join(x + rng.choice(["$$$", "###"]) for x in t.split()), f"lang{i % 2}", "junk" if i % 9 == 0 else f"site{i % 5}", 0))
        labels.append((i, int(good)))
    odd = [(2000, None, None, None, None), (2001, "", "x", "new", 0), (2002, words(rng, 20_000), "x", "new", 0), (2001, "", "x", "new", 0)]
    docs, table = spark.createDataFrame(rows + odd, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")
    weights = quality.fit(docs, table, usable="doc_id % 3 != 1")
    got = {r.doc_id: r for r in quality.score(docs, weights).collect()}
    assert len(got) == 903 and np.mean([got[i].kept == bool(y) for i, y in labels if i % 3 == 1]) >= 0.98
    assert got[0].host_rate < got[1].host_rate and all(0 <= r.score <= 1 for r in got.values())
    assert quality.fit(docs, table.limit(0)) is None and quality.score(docs.limit(0), weights).count() == 0
    alike = quality.score(docs, None).collect()
    assert all(abs(r.score - 0.5) < 1e-9 for r in alike)


def test_quality_against_brute_force(spark):
    """Rates of the other documents of a host and of its parts, shrunk by moments, in numpy."""
    rng = random.Random(16)
    rows = [(i, words(rng, rng.randrange(0, 40)), rng.choice(["a", "b", None]), rng.choice(["s", "t", None, f"rare{i}"]), 0) for i in range(300)]
    docs, weights = spark.createDataFrame(rows, DOCS).repartition(3), [rng.uniform(-1, 1) for _ in range(19)]
    got = {r.doc_id: r for r in quality.score(docs, weights).collect()}
    e = np.array([got[i].evidence for i in range(300)])
    assert all((x == 0) == (t == "") for x, (_, t, *_) in zip(e, rows, strict=True))
    p, mean = 1 / (1 + np.exp(-e)), np.mean(1 / (1 + np.exp(-e)))
    hosts, parts = collections.defaultdict(list), collections.defaultdict(list)
    for i, (_, _, lang, source, _) in enumerate(rows):
        hosts[source].append(i)
        parts[source, lang].append(i)

    def worth(groups, prior):
        n, k = sum(map(len, groups.values())), len(groups)
        within = sum(len(x) * p[x].var() for x in groups.values()) / n
        between = max(1e-6, (sum(len(x) * (p[x].mean() - prior(g)) ** 2 for g, x in groups.items()) - within * k) / n)
        return max(1.0, within / between)

    m = worth(hosts, lambda g: mean)
    whole = {h: (p[x].sum() + m * mean) / (len(x) + m) for h, x in hosts.items()}
    m2 = worth(parts, lambda g: whole[g[0]])
    odds = lambda x: np.log(np.clip(x, 1e-6, 1 - 1e-6) / (1 - np.clip(x, 1e-6, 1 - 1e-6)))
    for i, (_, _, lang, source, _) in enumerate(rows):
        h, q = ([j for j in x if j != i] for x in (hosts[source], parts[source, lang]))
        host_rate = (p[h].sum() + m * mean) / (len(h) + m)
        part_rate = (p[q].sum() + m2 * host_rate) / (len(q) + m2)
        assert (got[i].host_rate, got[i].part_rate) == pytest.approx((host_rate, part_rate), rel=1e-6)
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-(e[i] + odds(part_rate) - odds(mean)))), rel=1e-6)


def test_trust_goes_on_until_it_settles(spark):
    """A chain of hosts and two that link only to each other, against a solved system."""
    edges = [(f"h{i}", f"h{i + 1}", 1) for i in range(30)] + [("x", "y", 2), ("y", "x", 1), ("y", "h0", 1)]
    seeds = [("h0", 1.0, 0.0), ("x", 0.075, 0.075), ("y", 0.0, 0.2)]
    got = {r.host: r for r in urls.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, trust double, distrust double"), tolerance=1e-6).collect()}
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    for kind, k, pick in (("trust", 1, (0, 1)), ("distrust", 2, (1, 0))):
        m, s = np.zeros((len(names), len(names))), np.zeros(len(names))
        for e in edges:
            m[names.index(e[pick[1]]), names.index(e[pick[0]])] += e[2]
        m = 0.85 * m / np.maximum(m.sum(axis=0), 1)
        for row in seeds:
            s[names.index(row[0])] = row[k]
        for name, value in zip(names, np.linalg.solve(np.eye(len(names)) - m, s), strict=True):
            assert abs((got[name][kind] if name in got else 0.0) - value) < 1e-4


def test_operators_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "so nasty", "s", 2), (None, None, None, None)], "doc_id long, text string, score string, spans int")
    got = toxicity.score(docs, toxicity.Model(), names=("score_", "spans_"))
    assert got.columns == [*docs.columns, "score_", "spans_"] and {(r.score, r.spans) for r in got.collect()} == {("s", 2), (None, None)}
    vectors = spark.createDataFrame([(1, [1.0, 0.0], "x")], "vec_id long, embedding array<float>, component_id string")
    assert [(r.vec_id, r.component_id) for r in embeddings.near_duplicates(vectors).collect()] == [(1, 1)]
    assert [r.component_id for r in minhash.near_duplicates(docs.withColumn("band", F.lit("b"))).collect()] == [1, None]


def test_null_ids(spark):
    long = words(random.Random(16), 40)
    docs = spark.createDataFrame([(None, long), (3, long), (None, "other words here now"), (4, None)], "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == {(None, 3, False), (3, 3, True), (None, None, True), (4, 4, True)}
    labels = spark.createDataFrame([(3, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.learn(docs, labels)).count() == 4
    assert sorted(r.doc_id or -1 for r in packing.pack_documents(docs, queries.tokenizer_path()).collect()) == [-1, -1, 3, 4]
    vectors = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (None, None)], "vec_id long, embedding array<float>")
    assert {(r.vec_id, r.component_id, r.kept) for r in embeddings.near_duplicates(vectors).collect()} == {(None, 1, False), (1, 1, True), (None, None, True)}
