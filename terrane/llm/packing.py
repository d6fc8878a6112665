"""Best-fit packing by hierarchical residual packing."""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, lean

#: The split of byte-level BPE, with white space spelled out so that every regex engine agrees.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Scripts up to here are the same in every Unicode version that a regex engine may have.
PLAIN = "\u0590"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, the others for 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """A tokenizer file's ids.

    Where the file is a byte-level BPE whose merges are in the order of their ids, a rank-based encoder made from the
    same file gives the same ids several times as fast. Texts with scripts or added tokens in which the two could
    differ, and other kinds of files, go through the tokenizer itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self.by_rank(json.loads(self.tokenizer.to_str()))

    @staticmethod
    def by_rank(spec: dict):
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        if model["type"] != "BPE" or not plain or spec["normalizer"] or model.get("dropout") or model.get("ignore_merges"):
            return None
        import tiktoken

        letters, ranks = byte_letters(), {}
        added = {x["content"] for x in spec["added_tokens"]}
        for token, i in model["vocab"].items():
            if token not in added:
                ranks[bytes(letters[x] for x in token)] = i
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != list(range(256, 256 + len(merged))) or sorted(ranks.values()) != list(range(256 + len(merged))):
            return None
        return tiktoken.Encoding("by_rank", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast and max(text, default="") < PLAIN and not any(x in text for x in self.added):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except BaseException as e:  # its regex engine gives up on some very long runs
                if type(e).__name__ not in ("PanicException", "ValueError", "RuntimeError"):
                    raise
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def spans(n: int, max_len: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all of max_len but the first."""
    first = n % max_len or max_len
    return [(0, min(first, n))] + [(s, max_len) for s in range(first, n, max_len)]


def token_pieces(docs: DataFrame, tokenizer_path: str, max_len: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, uid, and with keep_ids also ids) of all documents' texts.

    A null text is an empty one and so has the end token alone. Repeated rows each give their pieces. uid is unique
    in one run and is fixed once the table is written.
    """

    @lean
    def encode(batches):
        encoder, n, at = Encoder(tokenizer_path), 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            out = [[] for _ in range(7)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encoder.ids(text.as_py() or ""), end_id).astype("<u4")
                for piece, (start, length) in enumerate(spans(len(ids), max_len)):
                    part = ids[start : start + length]
                    row = (doc_id, piece, start, length, zlib.crc32(part.tobytes()), at + n, part.astype("<i4") if keep_ids else None)
                    n += 1
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t, _ in zip(out, kinds, names, strict=False)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "uid", "ids"][: 7 if keep_ids else 6]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, schema)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset there, and the bins' fills.

    open_with[r] holds the bins with r left; one integer's bits say which r there are, so the tightest bin that
    still takes an item is found in a few operations.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets, fills = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    open_with: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits = 0
    for i in order.tolist():
        size = int(sizes[i])
        if fits := bits >> size:
            left = size + (fits & -fits).bit_length() - 1
            b = open_with[left].pop()
            if not open_with[left]:
                bits ^= 1 << left
        else:
            b, left = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        if left := left - size:
            open_with[left].append(b)
            bits |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def _round(items: DataFrame, capacity: int) -> DataFrame:
    """Packs the items (id, size) of each partition: rows (id, bin, at, fill, part)."""

    @lean
    def fit(batches):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not got or not sum(len(x) for x, _ in got):
            return
        ids, sizes = (np.concatenate(x) for x in zip(*got, strict=True))
        bins, at, fills = best_fit(sizes, capacity)
        firsts = np.full(len(fills), -1, np.int64)
        firsts[bins[::-1]] = ids[::-1]  # a bin is named by one of its items, so names stay unique
        columns = [ids, firsts[bins], at, fills[bins], np.full(len(ids), TaskContext.get().partitionId(), np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "bin", "at", "fill", "part"])

    return items.select("id", "size").mapInArrow(fit, "id long, bin long, at long, fill long, part int")


def pack(pieces: DataFrame, capacity: int = 1024, slack: int = 4, task_items: int = 200_000, fan_in: int = 8) -> DataFrame:
    """Packs pieces (uid, length, ...) into sequences: adds sequence_id and offset.

    Each partition packs its pieces by best fit. Bins within slack of full are done; the others become items of
    the next round, in fewer partitions (fan_in to one), until one round has seen them all together, or, where a
    task of task_items couldn't hold them, until a round saves less than a thousandth. Only ids and sizes move.
    """
    spark = pieces.sparkSession
    items = pieces.where(F.col("length") < capacity).select(F.col("uid").alias("id"), F.col("length").alias("size"))
    here, n_round = Written(_round(items, capacity), "pack").df, 0
    parts, placed = here.select("part").distinct().count(), here.drop("part")
    while True:
        bins = here.where((F.col("id") == F.col("bin")) & (F.col("fill") < capacity - slack)).select(F.col("bin").alias("id"), F.col("fill").alias("size"))
        n = bins.count()
        # One partition has seen all its bins already.
        if n < 2 or parts < 2:
            break
        parts = max(-(-parts // fan_in), -(-n // task_items))
        merged = Written(_round(bins.repartition(parts), capacity), "pack").df
        saved = n - merged.where("id = bin").count()
        up = merged.select(F.col("id").alias("bin"), F.col("bin").alias("above"), F.col("at").alias("higher"))
        placed = placed.join(up, "bin", "left").select(
            "id", F.coalesce("above", "bin").alias("bin"), (F.col("at") + F.coalesce("higher", F.lit(0))).alias("at")
        )
        here, n_round = merged, n_round + 1
        if parts > 1 and n_round > 3 and saved * 1000 < n:
            break
    where = placed.select(F.col("id").alias("uid"), F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))
    return pieces.join(where, "uid", "left").withColumns(
        {"sequence_id": F.coalesce("sequence_id", "uid"), "offset": F.coalesce("offset", F.lit(0)).cast("long")}
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, max_len: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """All documents in sequences of at most max_len tokens: a row for each piece, with its sequence and place.

    Empty table: no rows. Null or empty text: the end token alone. Texts of any length are cut into pieces of
    max_len (the first may be shorter). Equal sizes go in input order; repeated rows are packed each. Columns besides
    doc_id and text aren't read.
    """
    pieces = Written(token_pieces(docs, tokenizer_path, max_len, end_id, keep_ids), "pieces")
    return pack(pieces.df, max_len)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences' ids, from pack_documents(..., keep_ids=True). A sequence has at most max_len pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"), "parts.doc_id")
