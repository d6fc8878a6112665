"""Benchmark decontamination: SimHash of item-sized windows, multi-index blocks, exact weighted shingles."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, unused
from .shingles import WordHashes, mix, raw_texts, rolled

#: At similarity 0.8 windows as long as the item differ in 39 of 256 bits on average, with a deviation of under 6.
BITS, BLOCKS, RADIUS = 256, 8, 71
NEAR = RADIUS // BLOCKS  # within RADIUS, some block differs in at most so many of its 32 bits
STRETCH = 4096  # shingles whose running sums are in memory at once (more for an item that has more)
BLANK = re.compile(r"[\W_]+")
MATCH = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("similarity", T.DoubleType())])


class PlainWords(WordHashes):
    """Hashes of words in lower case, without punctuation; 0 for those that are nothing else."""

    def __missing__(self, word: bytes) -> int:
        plain = BLANK.sub("", word.decode(errors="replace").lower())
        h = self[word] = xxhash.xxh3_64_intdigest(plain) | 1 if plain else 0
        return h


def word_hashes(text: bytes, known: PlainWords) -> np.ndarray:
    h = known.of(text.split())
    return h[h != 0]


def sign_sums(shingles: np.ndarray) -> np.ndarray:
    """Running sums of each shingle's BITS signs, from 0 on."""
    raw = np.stack([mix(shingles ^ np.uint64(0x5555555555555555 * k)) for k in range(BITS // 64)], axis=1)
    out = np.zeros((len(shingles) + 1, BITS), np.int32)
    np.cumsum(np.unpackbits(raw.view(np.uint8).reshape(len(shingles), -1), axis=1).view(np.int8) * np.int8(2) - np.int8(1), axis=0, dtype=np.int32, out=out[1:])
    return out


def fingerprints(shingles: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the n shingles from each of the sorted starts: rows of BLOCKS words of 32 bits."""
    out, at = np.empty((len(starts), BLOCKS), np.uint32), 0
    while at < len(starts):
        low = int(starts[at])
        end = int(np.searchsorted(starts, low + max(1, STRETCH - n), side="right"))
        sums = sign_sums(shingles[low : int(starts[end - 1]) + n])
        own = starts[at:end] - low
        out[at:end] = np.packbits(sums[own + n] > sums[own], axis=1).view(np.uint32)
        at = end
    return out


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard of two multisets of shingles: a shingle weighs as often as it occurs."""
    (a, na), (b, nb) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    common = int(np.minimum(na[i], nb[j]).sum())
    return common / (len(x) + len(y) - common)


class Items:
    """Items of one number of shingles: their ids, shingles and fingerprints, and which items have a shingle."""

    def __init__(self, ids: list[int], shingles: list[np.ndarray]):
        self.ids, self.own, self.n = ids, shingles, len(shingles[0])
        self.prints = np.concatenate([fingerprints(s, np.zeros(1, np.int64), self.n) for s in shingles])
        pairs = np.unique(np.stack((np.concatenate(shingles), np.repeat(np.arange(len(shingles), dtype=np.uint64), self.n)), axis=1), axis=0)
        self.keys, self.first = np.unique(pairs[:, 0], return_index=True)
        self.first = np.append(self.first, len(pairs))
        self.having = pairs[:, 1].astype(np.int64)

    def windows(self, s: np.ndarray, hits: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, item) of every window of n of the shingles s that has a shingle of an item in it, each once. hits
        are the places of shingles that some item has."""
        at = np.minimum(np.searchsorted(self.keys, s[hits]), len(self.keys) - 1)
        same = self.keys[at] == s[hits]
        hits, at = hits[same], at[same]
        many = self.first[at + 1] - self.first[at]
        each = np.repeat(self.first[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
        item, place = self.having[each], np.repeat(hits, many)
        order = np.lexsort((place, item))
        item, place = item[order], place[order]
        # Windows that have the item's shingle before this one, too, are counted there.
        low = np.maximum(0, place - n + 1)
        again = np.flatnonzero(item[1:] == item[:-1]) + 1
        low[again] = np.maximum(low[again], place[again - 1] + 1)
        size = np.maximum(0, np.minimum(place, len(s) - n) - low + 1)
        return np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum()), np.repeat(item, size)


def within(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of fingerprints the multi-index blocks let through, and of those which are within RADIUS.

    If two fingerprints differ in RADIUS bits at most, one of their BLOCKS blocks does in RADIUS // BLOCKS at most: so
    none within the radius is missed. Of random ones, under 3 in a hundred pass."""
    apart = np.bitwise_count(x ^ y)
    likely = np.flatnonzero((apart <= NEAR).any(axis=1))
    return likely[apart[likely].sum(axis=1, dtype=np.int32) <= RADIUS]


class Index:
    """Items by their number of words, and a gate for the shingles that any of them has."""

    def __init__(self, items: list[tuple[int, str]], k: int):
        known, self.k, by_size = PlainWords(), k, {}
        for item_id, text in items:
            h = word_hashes((text or "").encode(), known)
            if len(h):
                ids, own = by_size.setdefault(len(h), ([], []))
                ids.append(item_id)
                own.append(rolled(h, k))
        self.sizes = {size: Items(ids, own) for size, (ids, own) in sorted(by_size.items())}
        every = [x.keys for x in self.sizes.values()]
        self.shingles = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        self.gate = np.zeros(1 << 20, bool)
        self.gate[(self.shingles >> np.uint64(44)).astype(np.int64)] = True

    def matches(self, h: np.ndarray, at: float) -> list[dict]:
        """Of a text's word hashes: for each item, the window of its size with the highest similarity of at or more,
        the first of equal ones; a text that is shorter than the item is one window."""
        out: list[dict] = []
        for k in {min(self.k, size) for size in self.sizes}:
            if len(h) < k:
                continue
            s = rolled(h, k)
            # A window that shares no shingle with an item has similarity 0 to it.
            hits = np.flatnonzero(self.gate[(s >> np.uint64(44)).astype(np.int64)])
            found = np.minimum(np.searchsorted(self.shingles, s[hits]), len(self.shingles) - 1)
            hits = hits[self.shingles[found] == s[hits]]
            if not len(hits):
                continue
            for size, items in self.sizes.items():
                if min(self.k, size) != k or len(s) / items.n < at:  # of fewer shingles, at most so many are common
                    continue
                n = min(items.n, len(s))
                start, item = items.windows(s, hits, n)
                if not len(start):
                    continue
                starts, of = np.unique(start, return_inverse=True)
                prints, best = fingerprints(s, starts, n), {}
                for i in range(0, len(start), 65536):
                    for c in (i + within(prints[of[i : i + 65536]], items.prints[item[i : i + 65536]])).tolist():
                        j, p = int(item[c]), int(start[c])
                        x = similarity(s[p : p + n], items.own[j])
                        if x >= at and (j not in best or x > best[j]["similarity"]):
                            best[j] = {"item_id": items.ids[j], "start": p, "words": min(size, len(h)), "similarity": x}
                out += best.values()
        return sorted(out, key=lambda m: m["item_id"])


def item_blocks(benchmark: DataFrame, most_items: int, most_bytes: int):
    """The items (item_id, text), in blocks that are small enough to travel with the tasks."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null").dropDuplicates()
    n, size = items.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    blocks = max(-(-n // most_items), -(-(size or 0) // most_bytes))
    for b in range(blocks):
        yield sorted(map(tuple, items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()), key=str)


def with_matches(docs: DataFrame, benchmark: DataFrame, k: int = 5, at: float = 0.8, most_items: int = 4096, most_bytes: int = 32_000_000, name: str = "matches") -> DataFrame:
    """docs with a column `name`: for each benchmark item, the document's window of as many words that is most similar
    to it, the first of equal ones, if that is at or more (item_id, start and words counted in words, similarity). A
    document that is shorter than the item is one window.

    Words are lower-cased and without punctuation. Similarity is the weighted Jaccard index of k-word shingles. Items
    with fewer than k words are one shingle; null and empty items and those with a null id match nothing, nor do null,
    empty and wordless texts. Very long texts are read whole, a stretch of their windows at a time. Repeated items
    count once, repeated documents and null ids each; an empty table gives no rows. A benchmark of more than most_items
    or most_bytes is applied in blocks, each in a pass over the documents. Nothing is shuffled. Other columns stay; one
    that has the name is replaced, so give another (common.unused finds one) where it should stay, too.
    """

    def marker(index: Index):
        @lean
        def mark(batches):
            known = PlainWords()
            for batch in batches:
                found = [
                    (old or []) + index.matches(word_hashes(t, known), at)
                    for t, old in zip(raw_texts(batch.column(text)), batch.column(name).to_pylist(), strict=True)
                ]
                yield batch.set_column(batch.schema.get_field_index(name), name, pa.array(found, batch.schema.field(name).type))

        return mark

    out = docs.drop(name).withColumn(name, F.array().cast(T.ArrayType(MATCH)))
    plain = docs.schema["text"].dataType == T.StringType()
    text = "text" if plain else unused(out, "text")  # no second copy where none is needed
    out = out if plain else out.withColumn(text, F.col("text").cast("string"))
    for items in item_blocks(benchmark, most_items, most_bytes):
        out = out.mapInArrow(marker(Index(items, k)), T.StructType([f if f.name != name else T.StructField(name, T.ArrayType(MATCH)) for f in out.schema]))
    return out if plain else out.drop(text)


def clean(name: str = "matches") -> Column:
    return F.size(name) == 0
