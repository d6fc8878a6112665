"""Removal of repeated byte strings: a Burrows-Wheeler transform, expanded breadth first up to the minimum length."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, lean, release, unused
from .shingles import mix

GRAM = 24
SCANNED, TRANSFORMED = 100_000, 500_000  # bytes at once (more where one text or fingerprint has more)
MOST_BYTES = 2_000_000  # of one fingerprint's pieces in a transform; beyond, they are dealt by more of their bytes
STRETCH = 8  # windows
SEPARATOR = 0xFF  # no byte of UTF-8
BASES = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)))
POWERS: dict[np.uint64, np.ndarray] = {}


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place."""
    w = b.astype(np.uint64)
    for k in (1, 2, 4):
        w = w[:-k] | (w[k:] << np.uint64(8 * k))
    return mix(w[:-16] * BASES[0] + (w[8:-8] ^ np.uint64(0x1234567)) * np.uint64(0xC2B2AE3D27D4EB4F) + w[16:] * np.uint64(0x165667B19E3779F9))


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """The least of the w values from each place, by minima of twice as many at a time."""
    size = 1
    while 2 * size <= w:
        h, size = np.minimum(h[:-size], h[size:]), 2 * size
    return h if size == w else np.minimum(h[: size - w], h[w - size :])


def powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers of an odd number, modulo 2 ** 64; kept for the next texts."""
    if len(POWERS.get(base, ())) < n:
        out = np.full(2 * n, base)
        out[:1] = 1
        POWERS[base] = np.multiply.accumulate(out)
    return POWERS[base][:n]


def ranges(h: np.ndarray, starts: np.ndarray, n: int | np.ndarray, base: np.uint64 = BASES[0]) -> np.ndarray:
    """A hash of the gram hashes from each start on, n of them, whatever their place."""
    sums = np.empty(len(h) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(h * powers(base, len(h)), out=sums[1:])
    back = powers(np.uint64(pow(int(base), -1, 2**64)), len(h))
    return mix((sums[starts + n] - sums[starts]) * back[starts])


def runs(b: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: (text, start, n, fingerprint, content, content2, inner), a row for each longest run of
    n windows of length bytes, all in one text, that have the same least gram hash. The contents are two hashes of the
    run's n + length - 1 bytes, 128 bits together.

    Equal windows have equal fingerprints, wherever they are. Two of one run (inner) can be equal only where the run
    goes on after a window that starts with the gram: the gram is then in it again.
    """
    begins = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
    if len(b) < length:
        z = np.zeros(0, np.int64)
        return z, z, z, *[z.astype(np.uint64)] * 3, z.astype(bool)
    h = gram_hashes(b)
    least = sliding_min(h, length - GRAM + 1)
    cut = np.ones(len(least) + 1, bool)
    np.not_equal(least[1:], least[:-1], out=cut[1:-1])
    for at in (begins, np.maximum(begins, ends - length + 1)):
        cut[at[at < len(cut)]] = True
    start = np.flatnonzero(cut[:-1])
    goes_on = (h[: len(least)] == least) & ~cut[1:]
    inner = np.logical_or.reduceat(goes_on, start)
    n = np.diff(np.append(start, len(least)))
    text = np.searchsorted(ends, start, side="right")
    ok = start + length <= ends[text]
    text, start, n, inner = text[ok], start[ok], n[ok], inner[ok]
    one, two = (ranges(h, start, n + length - GRAM, base) ^ mix(n.astype(np.uint64)) for base in BASES)
    return text, start - begins[text], n, least[start], one, two, inner


def chunks_of(column, most: int):
    """Pieces of an Arrow string column of about most bytes: (first row, bytes, ends of the texts)."""
    column = column.cast(pa.binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i + 1 : j + 1] - offsets[i]
        i = j


def changes(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def suffix_order(b: np.ndarray, depth: int) -> np.ndarray:
    """Places in b by their suffixes' first bytes, depth of them at least; b ends in enough separators."""
    n = len(b)
    padded = np.concatenate((b, np.full(8, SEPARATOR, np.uint8)))
    key = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]).view(">u8").ravel().astype(np.uint64)
    order = np.argsort(key).astype(np.int32)
    new = changes(key[order])
    rank = np.empty(n + 1, np.int32)
    rank[n] = n
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    known = 8
    while known < depth:
        # Only suffixes that share their known bytes with a neighbour are sorted on.
        tied = ~(new & np.append(new[1:], True))
        slots = np.flatnonzero(tied).astype(np.int32)
        if not len(slots):
            break
        places = order[slots]
        key = (rank[places].astype(np.int64) << 32) | rank[np.minimum(places + known, n)]
        by = np.argsort(key)
        places, differs = places[by], changes(key[by])
        order[slots] = places
        new[slots] |= differs
        rank[places] = slots[np.maximum.accumulate(np.where(differs, np.arange(len(slots), dtype=np.int32), 0))]
        known *= 2
    return order


def prefix_bounds(bwt: np.ndarray, length: int) -> np.ndarray:
    """Where rows r - 1 and r of a sorted transform share fewer than length bytes, from r = 0 to its size.

    Intervals of rows that share a prefix are expanded backward by each byte before them, breadth first, so common
    prefixes turn up by increasing value; an interval goes on only if its end was unknown. Stops at length.
    """
    n = len(bwt)
    by_byte = np.argsort(bwt, kind="stable").astype(np.int32)
    lf = np.empty(n, np.int32)
    lf[by_byte] = np.arange(n, dtype=np.int32)
    same = ~changes(bwt[by_byte])[1:]
    after, before = np.full(n, n, np.int32), np.full(n, -1, np.int32)
    after[by_byte[:-1][same]] = by_byte[1:][same]
    before[by_byte[1:][same]] = by_byte[:-1][same]
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    low, high = np.zeros(1, np.int32), np.full(1, n, np.int32)
    for _ in range(length):
        if not len(low):
            break
        sizes = high - low
        ends = np.cumsum(sizes, dtype=np.int32)
        rows = np.repeat(low - ends + sizes, sizes) + np.arange(ends[-1], dtype=np.int32)
        lasts = np.sort(lf[rows[after[rows] >= np.repeat(high, sizes)]]) + 1
        firsts = np.sort(lf[rows[before[rows] < np.repeat(low, sizes)]])
        new = ~known[lasts]
        low, high = firsts[new], lasts[new]
        known[high] = True
    return known


def repeated_starts(pieces: list[bytes], length: int) -> np.ndarray:
    """Of pieces in order: whether the length bytes from each place of all pieces, each with a separator after it, also start earlier."""
    b = np.frombuffer(bytes([SEPARATOR]).join(pieces) + bytes([SEPARATOR]) * (length + 28), np.uint8)
    order = suffix_order(b, length + 1)
    bounds = prefix_bounds(b[order - 1], length)
    sizes = np.array([len(x) + 1 for x in pieces])
    begins = np.cumsum(sizes) - sizes
    valid = np.zeros(len(b) + 1, np.int32)  # a window starts here
    np.add.at(valid, begins, 1)
    np.add.at(valid, begins + np.maximum(0, sizes - length), -1)
    valid = np.cumsum(valid)[:-1] > 0
    group = np.cumsum(bounds[:-1]) - 1
    first = np.full(int(group[-1]) + 1, len(b), np.int64)
    live = valid[order]
    at, g = order[live], group[live]
    if len(at):
        turn = np.flatnonzero(np.concatenate((np.ones(1, bool), g[1:] != g[:-1])))
        first[g[turn]] = np.minimum.reduceat(at, turn)
    out = np.zeros(len(b), bool)
    out[at[first[g] < at]] = True
    return out


def spans_of(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate((np.zeros(1, np.int8), marked.astype(np.int8), np.zeros(1, np.int8))))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def place_columns() -> tuple[Column, Column, Column]:
    """A document's place (doc, turn), and its text. Rows of equal doc_id and different texts have different turns; a
    null doc_id is one of its own for each text, from 2 ** 62 on."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    alone = F.shiftrightunsigned(F.xxhash64(text, F.lit(7)), 2).bitwiseOR(F.lit(2**62))
    return F.coalesce(F.col("doc_id").cast("long"), alone), F.xxhash64(text), text


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """runs() of all documents: (doc, turn, at, fp, sh, sh2); at holds start, n and inner."""
    names = ["doc", "turn", "at", "fp", "sh", "sh2"]

    @lean
    def scan(batches):
        for batch in batches:
            ids, turns = (batch.column(i).to_numpy() for i in (0, 1))
            for row, b, ends in chunks_of(batch.column(2), SCANNED):
                text, start, n, fp, sh, sh2, inner = runs(b, ends, length)
                at = start << 16 | n << 1 | inner
                columns = [ids[row + text], turns[row + text], at, fp.view(np.int64), sh.view(np.int64), sh2.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return docs.select("doc", "turn", "text").mapInArrow(scan, ", ".join(f"{n} long" for n in names))


def start_of(at: str = "at") -> Column:
    return F.shiftright(at, 16)


def n_of(at: str = "at") -> Column:
    return F.shiftright(at, 1).bitwiseAND(F.lit(0x7FFF))


def inner_of(at: str = "at") -> Column:
    return F.col(at).bitwiseAND(F.lit(1)) == 1


def cut_out(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Of the runs wanted (doc, turn, fp, start, n, crowded): (fp, doc, turn, start, n, bytes, stretch) of each.

    Crowded runs are cut into stretches of STRETCH windows, by the windows' distance from their gram, and fp is a hash
    of the bytes that all windows of a full stretch share. Equal windows have their gram at the same distance and so
    share that, too. Crowded runs that hold their gram twice are cut into single windows.
    """
    by_doc = wanted.groupBy("doc", "turn").agg(F.collect_list(F.struct("fp", "start", "n", "crowded")).alias("runs"))
    grams = length - GRAM + 1

    def stretches(b: bytes, fp, start, n):
        h, out = gram_hashes(np.frombuffer(b, np.uint8)), []
        for f, s, k in zip(fp.view(np.uint64), start.tolist(), n.tolist(), strict=True):
            at = np.flatnonzero(h[s : s + k + grams - 1] == f) + s
            gram = at[np.searchsorted(at, np.arange(s, s + k))]  # the first in each window
            low = gram - (gram - np.arange(s, s + k)) // STRETCH * STRETCH - STRETCH + 1
            begin, first, many = np.unique(low, return_index=True, return_counts=True)
            out.append((begin, s + first, many))
        begin, first, many = (np.concatenate(c) for c in zip(*out, strict=True))
        # A full stretch starts at begin; from its last window's start its windows share length - STRETCH + 1 bytes.
        return ranges(h, begin + STRETCH - 1, grams - STRETCH + 1).view(np.int64), first, many

    @lean
    def cut(batches):
        for batch in batches:
            rest = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3), strict=True)
            for doc, turn, b, runs_ in rest:
                rows = runs_.values
                fp, start, n, crowded = (rows.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                keys, at, many = fp[~crowded], start[~crowded], n[~crowded]
                whole = len(keys)
                if crowded.any():
                    more = stretches(b, fp[crowded], start[crowded], n[crowded])
                    keys, at, many = (np.concatenate(c) for c in zip((keys, at, many), more, strict=True))
                pieces = [b[s : s + k + length - 1] for s, k in zip(at.tolist(), many.tolist(), strict=True)]
                same = [pa.array(np.full(len(at), x, np.int64)) for x in (doc, turn)]
                columns = [pa.array(keys), *same, pa.array(at), pa.array(many), pa.array(pieces, pa.binary()), pa.array(np.arange(len(at)) >= whole)]
                yield pa.RecordBatch.from_arrays(columns, names=["fp", "doc", "turn", "start", "n", "bytes", "stretch"])

    schema = "fp long, doc long, turn long, start long, n long, bytes binary, stretch boolean"
    return docs.join(by_doc, ["doc", "turn"]).select("doc", "turn", "text", "runs").mapInArrow(cut, schema)


def transformed(pieces: DataFrame, length: int) -> DataFrame:
    """Spans (doc, turn, start, end) of the pieces' bytes that an earlier piece of the same fingerprint has, too."""

    @lean
    def expand(batches):
        held, size, last = [], 0, None

        def flush():
            rows = sorted(held)
            rows = [r for r, before in zip(rows, [None, *rows], strict=False) if r != before]  # a document given twice is one
            marks = repeated_starts([r[3] for r in rows], length)
            begins, ends = spans_of(marks)
            sizes = np.array([len(r[3]) + 1 for r in rows])
            first = np.cumsum(sizes) - sizes
            of = np.searchsorted(first, begins, side="right") - 1
            doc, turn, start = (np.array([r[i] for r in rows], np.int64)[of] for i in range(3))
            columns = [doc, turn, start + begins - first[of], start + ends - 1 - first[of] + length]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc", "turn", "start", "end"])

        for batch in batches:
            for fp, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= TRANSFORMED and fp != last:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[3]), fp
        if held:
            yield flush()

    rows = pieces.repartition("fp").sortWithinPartitions("fp").select("fp", "doc", "turn", "start", "bytes")
    return rows.mapInArrow(expand, "doc long, turn long, start long, end long")


def repeated_spans(docs: DataFrame, length: int = 100, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Spans (doc, turn, start, end) that cover the bytes of docs (doc, turn, text) in a string of length bytes that
    also starts earlier: at a smaller (doc, turn), or earlier in the same.

    A window's fingerprint is the least hash of the GRAM-byte strings in it, so equal windows share it, and
    neighbours that share one make a run of about 40 windows. Only runs whose fingerprint occurs twice, or that may
    repeat within, go on. Runs of equal content (by 128 bits, beside the fingerprint's 64) collapse to the first, which
    covers the others. Those left of one fingerprint meet in a Burrows-Wheeler transform, which compares bytes.

    A fingerprint may have more bytes of different contents than a task should hold (most_bytes): the edge of a passage
    that very many texts share. Such runs are cut into stretches that are dealt by more of their bytes, equal ones
    collapse by their bytes, and the others meet in transforms like all. Where a stretch has too many still, its
    windows are dealt by all of their bytes: rows of one interval, and no others, then have the same key.
    """
    spark = docs.sparkSession
    place = ["doc", "turn"]
    found = Written(anchors(docs, length), "suffix-runs")
    again = found.df.groupBy("fp").agg(F.count(F.lit(1)).alias("times"), F.max(inner_of()).alias("within")).where("times > 1 or within").select("fp")
    runs_ = Written(found.df.join(again, "fp"), "suffix-again")
    del again
    found.drop()
    release(spark)
    content = ["fp", "sh", "sh2"]
    at = F.struct(*place, "at")
    kept_firsts = Written(runs_.df.groupBy(*content).agg(F.min(at).alias("first")), "suffix-firsts")
    firsts = kept_firsts.df
    ends = lambda n: (F.col("start") + n + (length - 1)).alias("end")
    copies = runs_.df.join(firsts, content).where(at != F.col("first")).withColumn("start", start_of())
    kept_copies = Written(copies.select(*place, "start", ends(n_of())), "suffix-copies")
    runs_.drop()
    release(spark)
    sized = firsts.select("fp", "first.*").select("fp", *place, start_of().alias("start"), n_of().alias("n"), inner_of().alias("inner"))
    shape = sized.groupBy("fp").agg(F.count(F.lit(1)).alias("contents"), F.sum(F.col("n") + (length - 1)).alias("size"), F.max("inner").alias("within")).where("contents > 1 or within")
    mixed = sized.join(shape.select("fp", (F.col("size") > most_bytes).alias("crowded")), "fp").select("fp", *place, "start", "n", "crowded")
    kept_pieces = Written(cut_out(docs, mixed, length), "suffix-pieces")
    pieces = kept_pieces.df
    kept_firsts.drop()
    release(spark)
    plain = pieces.where("not stretch").select("fp", *place, "start", "bytes")
    stretches, at = pieces.where("stretch"), F.struct(*place, "start")
    kept_heads = Written(stretches.groupBy("fp", "bytes").agg(F.min(at).alias("first"), F.any_value("n").alias("n")), "suffix-heads")
    heads = kept_heads.df
    copies2 = stretches.join(heads.select("fp", "bytes", "first"), ["fp", "bytes"]).where(at != F.col("first")).select(*place, "start", ends(F.col("n")))
    shape2 = heads.groupBy("fp").agg(F.count(F.lit(1)).alias("contents"), F.sum(F.length("bytes")).alias("size"))
    shape2 = shape2.where("contents > 1").select("fp", (F.col("size") > most_bytes).alias("crowded"))
    mixed2 = heads.join(shape2, "fp").select("fp", "first.*", "n", "bytes", "crowded")
    plain = plain.unionByName(mixed2.where("not crowded").select("fp", *place, "start", "bytes"))
    windows = mixed2.where("crowded").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    windows = windows.select(*place, (F.col("start") + F.col("i")).alias("start"), F.substring("bytes", F.col("i") + 1, F.lit(length)).alias("window"))
    seen = windows.groupBy("window").agg(F.count(F.lit(1)).alias("times"), F.min(at).alias("first")).where("times > 1").drop("times")
    single = windows.join(seen, "window").where(at != F.col("first")).select(*place, "start", (F.col("start") + length).alias("end"))
    out = Written(kept_copies.df.unionByName(copies2).unionByName(single).unionByName(transformed(plain, length)), "suffix-spans").df
    del copies, copies2, single, pieces, plain, stretches, heads, sized, shape, shape2, mixed, mixed2, windows, seen, firsts
    for kept in (kept_copies, kept_pieces, kept_heads):
        kept.drop()
    release(spark)
    return out


def with_spans(docs: DataFrame, length: int) -> tuple[DataFrame, str]:
    """docs with a column of spans, as start << 32 | end, null where nothing repeats; and its name."""
    doc, turn, text = place_columns()
    name, doc_name, turn_name = (unused(docs, c) for c in ("spans", "doc", "turn"))
    spans = repeated_spans(docs.select(doc.alias("doc"), turn.alias("turn"), text.alias("text")), length)
    by_doc = spans.select("doc", "turn", (F.shiftleft("start", 32) + F.col("end")).alias("span")).groupBy("doc", "turn").agg(F.collect_list("span").alias("spans"))
    by_doc = by_doc.select(F.col("doc").alias(doc_name), F.col("turn").alias(turn_name), F.col("spans").alias(name))
    return docs.withColumns({doc_name: doc, turn_name: turn}).join(by_doc, [doc_name, turn_name], "left").select(*docs.columns, name), name


def kept_of(raw: bytes, spans) -> tuple[bytes, int, int]:
    """The bytes outside the spans, how many are inside, and the number of maximal runs inside."""
    if spans is None or not len(spans):
        return raw, 0, 0
    spans = np.sort(spans)
    starts, ends = spans >> 32, spans & 0xFFFFFFFF
    reach = np.maximum.accumulate(ends)
    new = np.concatenate((np.ones(1, bool), starts[1:] > reach[:-1]))
    starts, ends = starts[new], np.append(reach[:-1][new[1:]], reach[-1])
    parts, at = [], 0
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        parts.append(raw[at:s])
        at = e
    parts.append(raw[at:])
    return b"".join(parts), int((ends - starts).sum()), len(starts)


def remove_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """Removes every byte that a string of length bytes covers which also starts earlier: in a document of smaller
    doc_id, or earlier in the same one. Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary).

    Null text is empty and loses nothing, like texts under length bytes; very long texts are read whole. Matches don't
    cross documents. Rows of equal doc_id and text are one document given twice: neither is earlier than the other, and
    both lose the same. Rows of equal doc_id and different texts are different documents, in the order of a hash of
    their texts; so are rows with a null doc_id, after those under 2 ** 62. An empty table gives no rows; other columns
    aren't read.
    """

    @lean
    def keep(batches):
        for batch in batches:
            out = []
            for raw, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2), strict=True):
                raw = raw or b""
                kept, n, k = kept_of(raw, spans.values.to_numpy() if spans.is_valid else None)
                out.append((len(raw), n, k, hashlib.sha256(kept).hexdigest(), kept))
            columns = zip(*out, strict=True) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            arrays = [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    rows, name = with_spans(docs.select("doc_id", "text"), length)
    rows = rows.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), name)
    return rows.mapInArrow(keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """docs with the text that is left, as UTF-8: letters of which a byte was removed go whole. Documents that lost all
    of their text go. Other columns stay, whatever their names; n_chars follows the text where there is one. Nulls, odd
    ids and repeated rows as in remove_repeats; an empty table gives no rows."""

    @lean
    def keep(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts, lost = [], []
            for raw, spans in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(name), strict=True):
                if raw is None or not spans.is_valid:
                    texts.append(raw.decode() if raw is not None else None)
                    lost.append(False)
                    continue
                kept, n, _ = kept_of(raw, spans.values.to_numpy())
                text = kept.decode(errors="ignore")
                texts.append(text)
                lost.append(n > 0 and not text)
            batch = batch.set_column(at, "text", pa.array(texts, pa.string()))
            yield batch.filter(pa.array([not x for x in lost])).select(columns)

    columns = docs.columns
    rows, name = with_spans(docs, length)
    out = rows.mapInArrow(keep, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out
