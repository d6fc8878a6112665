"""MinHash near-duplicates with sequential Bayesian verification."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, components, lean, release
from .shingles import WordHashes, mix, raw_texts, shingle_set

BLOCK = 4096  # shingles hashed at once


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:n] | np.uint64(1), x[n:]


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the least of each permutation over a set that isn't empty."""
    least = np.full(len(a), np.uint64(2**64 - 1))
    for i in range(0, len(shingles), BLOCK):
        part = shingles[i : i + BLOCK]
        least = np.minimum(least, (part[None, :] * a[:, None] + b[:, None]).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def least_matches(n: int, at: float, miss: float) -> int:
    """The fewest matches among n hashes at which the similarity is still `at` or more with a posterior (uniform
    prior) probability of miss or more: P(Beta(m + 1, n - m + 1) >= at) = P(Binomial(n + 1, at) <= m)."""
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * at**m * (1 - at) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, sig): set size, 128-bit digest of the set, and MinHash signature, null if empty."""

    @lean
    def sign(batches):
        known = WordHashes()
        a, b = permutations(bands * rows)
        for batch in batches:
            n, d1, d2, sig = [], [], [], []
            for text in raw_texts(batch.column(1)):
                s = shingle_set(text, k, known)
                n.append(len(s))
                sig.append(signature(s, a, b).tobytes() if len(s) else None)
                with np.errstate(over="ignore"):
                    d1.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else None)
                    d2.append(int(mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64).view(np.int64)) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sig, pa.binary())],
                names=["doc_id", "n_shingles", "d1", "d2", "sig"],
            )

    rows_in = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows_in.mapInArrow(sign, "doc_id long, n_shingles long, d1 long, d2 long, sig binary")


def own_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """The bands' keys of each row of a matrix of signatures."""
    sig = sig.reshape(len(sig), bands, -1)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), sig.shape[:2])
    for i in range(sig.shape[2]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, i])
    return key.view(np.int64)


def band_keys(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(id, band): a 64-bit key of each band of each signature."""

    @lean
    def cut(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(batch.num_rows, -1)
            key = own_keys(sig, bands)
            ids = np.repeat(batch.column(0).to_numpy(), bands)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(key.ravel())], names=["id", "band"])

    return classes.select("id", "sig").mapInArrow(cut, "id long, band long")


def pruned(pairs: DataFrame, classes: DataFrame, at: float, miss: float, batch_hashes: int) -> DataFrame:
    """Pairs (a, b) that no batch of hashes ruled out: after each, a pair goes on only while the posterior
    probability of a similarity of at or more is miss or more. Sizes too far apart rule out at once."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    near = (F.least("n_a", "n_b") * 1.0 >= at * F.greatest("n_a", "n_b")) if at > 0 else F.lit(True)

    @lean
    def test(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for i in (2, 3))
            live, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for i in range(0, x.shape[1], batch_hashes):
                end = min(i + batch_hashes, x.shape[1])
                matches[live] += (x[live, i:end] == y[live, i:end]).sum(axis=1)
                live = live[matches[live] >= least_matches(end, at, miss)]
            yield batch.select(["a", "b"]).take(pa.array(live))

    return pairs.join(side("a"), "a").join(side("b"), "b").where(near).select("a", "b", "sig_a", "sig_b").mapInArrow(test, "a long, b long")


def shingle_sets(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(id, hashes): the full shingle sets of the documents with these ids, which are unique."""

    @lean
    def sets(batches):
        known = WordHashes()
        for batch in batches:
            out = [shingle_set(t, k, known).tobytes() for t in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "hashes"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")).join(ids, "id", "left_semi")
    return texts.mapInArrow(sets, "id long, hashes binary").dropDuplicates(["id"])


def common_of(x: np.ndarray, y: np.ndarray) -> int:
    both = np.sort(np.concatenate((x, y)))
    return int((both[1:] == both[:-1]).sum())


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    @lean
    def confirm(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = common_of(x, y)
                if 100 * common >= percent * (len(x) + len(y) - common):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    side = lambda x: sets.select(F.col("id").alias(x), F.col("hashes").alias(f"set_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(confirm, "a long, b long")


def commons(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Intersection sizes of each left set with each right one, exactly: a product of 0/1 matrices, for a part of the shingles at a time."""
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values = np.concatenate(sets)
    _, at, n = np.unique(values, return_inverse=True, return_counts=True)
    rows, at = rows[n[at] > 1], at[n[at] > 1]
    _, at = np.unique(at, return_inverse=True)
    order = np.argsort(at, kind="stable")
    rows, at = rows[order], at[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, BLOCK):
        i, j = np.searchsorted(at, (low, low + BLOCK))
        has = np.zeros((len(sets), BLOCK), np.float32)
        has[rows[i:j], at[i:j] - low] = 1
        out += has[left] @ has[right].T
    return out.astype(np.int64)


def live_pairs(table: pa.Table, bands: int, percent: int, miss: float, batch_hashes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, live): rows of a pair of blocks (i, j), and which of left x right their sizes and signatures leave:
    of different components, met in no earlier band, and ruled out by no batch of hashes."""
    get = lambda c: table.column(c).to_numpy()
    ids, comps, sizes, first = get("id"), get("comp"), get("n_shingles"), get("block") == table.column("i")[0].as_py()
    left = np.flatnonzero(first)
    right = left if table.column("i")[0].as_py() == table.column("j")[0].as_py() else np.flatnonzero(~first)
    live = comps[left][:, None] != comps[right][None, :]
    if not live.any():
        return left, right, live
    small, large = np.minimum.outer(sizes[left], sizes[right]), np.maximum.outer(sizes[left], sizes[right])
    live &= 100 * small >= percent * large
    if right is left:
        live &= ids[left][:, None] < ids[right][None, :]
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(ids), -1)
    keys = own_keys(sig, bands)
    here = int(np.flatnonzero(keys[0] == table.column("band")[0].as_py())[0])
    for b in range(here):
        live &= keys[left, b][:, None] != keys[right, b][None, :]
    matches = np.zeros(live.shape, np.int16)
    for i in range(0, sig.shape[1], batch_hashes):
        if not live.any():
            break
        end = min(i + batch_hashes, sig.shape[1])
        for h in range(i, end):
            matches += sig[left, h][:, None] == sig[right, h][None, :]
        live &= matches >= least_matches(end, percent / 100, miss)
    return left, right, live


def linked_blocks(members: DataFrame, classes: DataFrame, sets: DataFrame, bands: int, percent: int, miss: float, batch_hashes: int, size: int) -> DataFrame:
    """Links (a, b) between members (band, id, comp) of one bucket and different components, enough to join all
    components that any such link joins.

    A bucket's members are dealt into blocks of about size, and each two blocks meet in a task. Members of the
    component with the most members don't need each other, so their blocks meet the others' blocks only. Two
    documents that share several bands are compared in the first one. Blocks meet by signatures first; full sets go
    only where a member has a pair left that no batch of hashes ruled out.
    """
    by_comp = members.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"))
    shape = by_comp.groupBy("band").agg(F.sum("n").alias("all"), F.max(F.struct("n", "comp")).alias("top")).select(
        "band", F.col("top.comp").alias("big"), F.ceil((F.col("all") - F.col("top.n")) / size).alias("few"), F.ceil(F.col("top.n") / size).alias("many")
    )
    shape = Written(shape, "minhash-shape").df
    slot = F.xxhash64("id", F.lit(7))
    dealt = members.join(shape, "band").withColumn(
        "block", F.when(F.col("comp") == F.col("big"), F.col("few") + F.pmod(slot, F.col("many"))).otherwise(F.pmod(slot, F.col("few")))
    )
    lower = F.transform(F.sequence(F.lit(0).cast("long"), F.least("block", F.col("few") - 1)), lambda i: F.struct(i.alias("i"), F.col("block").alias("j")))
    upper = F.when(
        (F.col("block") < F.col("few")) & (F.col("block") + 1 < F.col("few") + F.col("many")),
        F.transform(F.sequence(F.col("block") + 1, F.col("few") + F.col("many") - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j"))),
    ).otherwise(F.array().cast("array<struct<i:bigint,j:bigint>>"))
    signed = dealt.join(classes.select("id", "sig", "n_shingles"), "id")
    met = signed.select("band", "id", "comp", "block", "sig", "n_shingles", F.explode(F.concat(lower, upper)).alias("at"))
    met = met.select("band", "id", "comp", "block", "sig", "n_shingles", "at.i", "at.j")
    named = ["band", "id", "comp", "block", "i", "j"]

    def likely(table):
        left, right, live = live_pairs(table, bands, percent, miss, batch_hashes)
        some = np.union1d(left[live.any(axis=1)], right[live.any(axis=0)])
        return table.select(named).take(pa.array(some, pa.int64()))

    open_ = Written(met.groupBy("band", "i", "j").applyInArrow(likely, ", ".join(f"{c} long" for c in named)), "minhash-likely").df
    full = open_.join(classes.select("id", "sig", "n_shingles"), "id").join(sets, "id")

    def meet(table):
        left, right, live = live_pairs(table, bands, percent, miss, batch_hashes)
        x, y = np.nonzero(live)
        ids, comps = table.column("id").to_numpy(), table.column("comp").to_numpy()
        hashes = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        sizes = np.array([len(x) for x in hashes])
        if len(x) > 4 * (len(left) + len(right)):
            common = commons(hashes, left, right)[x, y]
        else:
            common = np.array([common_of(hashes[left[i]], hashes[right[j]]) for i, j in zip(x, y, strict=True)], np.int64)
        ok = 100 * common >= percent * (sizes[left[x]] + sizes[right[y]] - common)
        x, y = left[x[ok]], right[y[ok]]
        root: dict = {}

        def find(c):
            while (up := root.get(c, c)) != c:
                root[c] = root.get(up, up)
                c = up
            return c

        a, b = [], []
        for i, j in zip(x, y, strict=True):
            p, q = find(comps[i]), find(comps[j])
            if p != q:
                root[max(p, q)] = min(p, q)
                a.append(ids[i])
                b.append(ids[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return full.groupBy("band", "i", "j").applyInArrow(meet, "a long, b long")


def near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 24, rows: int = 4, miss: float = 1e-5, batch_hashes: int = 16, block: int = 512
) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept): near-duplicate groups of documents by their k-word shingles.

    Documents with equal sets are one class, by a 128-bit digest of the set. Classes that share a band are candidates; sequential Bayesian pruning on
    the signatures comes first, then the test on full sets. Each bucket's members first meet one leader, and links
    make components. Only buckets in which several components are left compare the members of different components,
    in blocks. So no link of candidates that could join two components goes untested. A pair at the threshold shares
    no band with probability (1 - 0.8 ** rows) ** bands, 3e-6 as set.

    Null and empty texts, and those without words, have no shingles and no links. Fewer than k words are one shingle.
    Repeated rows of one doc_id give one row each; their texts are taken to be equal. A null doc_id links with nothing new:
    it has the component of an equal text, if any. Other columns aren't read.
    """
    spark, at = docs.sparkSession, percent / 100
    signed = Written(signatures(docs, k, bands, rows), "minhash-signed").df
    some = signed.where("sig is not null and doc_id is not null")
    classes = Written(
        some.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("sig").alias("sig")),
        "minhash-classes",
    ).df
    # A row for each band in which a class isn't alone.
    # What is counted of bands is written before it joins them: a join whose sides come straight from their shuffles
    # may split a band that very many classes share.
    keys = band_keys(classes, bands, rows)
    shared = keys.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min_by("id", F.xxhash64("id", "band")).alias("leader")).where("n > 1")
    shared = Written(shared.drop("n"), "minhash-shared").df
    members = Written(keys.join(shared, "band"), "minhash-members").df
    sets = Written(shingle_sets(members.select("id").distinct(), docs, k), "minhash-sets").df
    release(spark)
    tried = members.where("id != leader").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
    likely = pruned(tried, classes.select("id", "sig", "n_shingles"), at, miss, batch_hashes)
    links = Written(verified(likely, sets, percent), "minhash-links").df
    comps = components(links, "minhash")
    labelled = members.where("id != leader").join(comps.withColumnRenamed("node", "id"), "id", "left")
    labelled = labelled.select("band", "id", F.coalesce("component", "id").alias("comp"))
    # A leader has met all its bucket; what is open is between the others.
    several = labelled.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("band")
    several = Written(several, "minhash-several").df
    left = Written(labelled.join(several, "band", "left_semi"), "minhash-left").df
    more = Written(linked_blocks(left, classes, sets, bands, percent, miss, batch_hashes, block), "minhash-more").df
    if not more.isEmpty():
        comps = components(links.unionByName(more), "minhash")
    of_class = classes.select("d1", "d2", "id").join(comps.withColumnRenamed("node", "id"), "id", "left")
    of_class = of_class.select("d1", "d2", F.coalesce("component", "id").alias("component_id"))
    out = signed.drop("sig").join(of_class, ["d1", "d2"], "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
