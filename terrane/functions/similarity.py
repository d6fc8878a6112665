"""Similarities of strings and vectors as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, with a bit for each letter of a."""
    at: dict[str, int] = {}
    for i, letter in enumerate(a):
        at[letter] = at.get(letter, 0) | 1 << i
    ones = v = (1 << len(a)) - 1
    for letter in b:
        u = v & at.get(letter, 0)
        v = (v + u | v - u) & ones
    return len(a) - v.bit_count()


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whole integers hold the bits, so a batch of pairs takes microseconds each; nested lambdas over letters took a
    hundred times as long."""
    known: dict[tuple[str, str], float | None] = {}

    def of(x, y):
        if x is None or y is None:
            return None
        if (x, y) not in known:
            known[x, y] = 200.0 * common_subsequence(x, y) / (len(x) + len(y)) if x or y else 100.0
        return known[x, y]

    return pd.Series([of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """200 * longest common subsequence / letters of both; 100 if both are empty."""
    return _ratio(a, b)


def possible(a: Column, b: Column, least: float) -> Column:
    """Whether lengths alone leave a ratio of least possible."""
    return F.coalesce(F.try_divide(200.0 * F.least(F.length(a), F.length(b)), F.length(a) + F.length(b)) >= least, F.lit(True))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def token_sort(c: Column) -> Column:
    return F.array_join(F.array_sort(tokens(c)), " ")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return ratio(token_sort(a), token_sort(b))


def token_set_ratio(a: Column, b: Column) -> Column:
    """The best ratio among the common tokens and those plus each side's own; 100 if one side has no own tokens and
    there are common ones; 0 if a side has none."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    join = lambda c: F.array_join(F.array_sort(c), " ")
    common, left, right = join(F.array_intersect(x, y)), join(F.array_except(x, y)), join(F.array_except(y, x))
    one, two = F.trim(F.concat_ws(" ", common, left)), F.trim(F.concat_ws(" ", common, right))
    best = F.greatest(ratio(one, two), F.when(common != "", F.greatest(ratio(common, one), ratio(common, two))).otherwise(0.0))
    contained = (common != "") & ((left == "") | (right == ""))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).when(contained, 100.0).otherwise(best)


def token_set_keys(c: Column) -> Column:
    """Strings of which two texts with a token-set ratio of 80 or more share one: tokens; letter pairs of the sorted
    distinct tokens; letters, if there are three at most.

    Without a common token the ratio is that of the sorted tokens. Of L letters in both, l of each are then common and
    l >= 0.4 L. Of the l - 1 pairs of neighbours among those, at most L - 2 l are torn, so 3 l - 1 - L pairs are shared:
    one or more unless L = 5 and l = 2, where one text has two letters and the other three.
    """
    own = F.array_distinct(tokens(c))
    row = F.array_join(F.array_sort(own), " ")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(row) - 1, F.lit(1))), lambda i: F.concat(F.lit("2"), F.substring(row, i, F.lit(2))))
    letters = F.when(F.length(row) <= 3, F.transform(F.filter(F.split(row, ""), lambda x: x != ""), lambda x: F.concat(F.lit("1"), x))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.transform(own, lambda t: F.concat(F.lit("t"), t)), pairs, letters))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, most_queries: int = 2048) -> DataFrame:
    """Each query's k nearest of all vectors (both vec_id, embedding) but those of its own id: rows (q, id, place,
    cosine), by cosine in billionths and then id. Pairs without a cosine (null, zero or of other length) have no row.

    At most most_queries are applied in a pass over the vectors. Each batch keeps k a query, so the window gets few.
    """
    queries = queries.select("vec_id", "embedding").where("vec_id is not null and embedding is not null")
    blocks = max(1, -(-queries.count() // most_queries))
    found = None
    for b in range(blocks):
        block = [tuple(r) for r in queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()]
        part = vectors.select("vec_id", "embedding").mapInArrow(_nearest_in_batches(block, k), "q long, id long, near long, c double")
        found = part if found is None else found.union(part)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("near"), "id"))
    return found.withColumn("place", place.cast("long")).where(F.col("place") <= k).select("q", "id", "place", F.col("c").alias("cosine"))


def _nearest_in_batches(queries: list[tuple], k: int, many: int = 256, rows: int = 4096):
    """A function for mapInArrow: of each batch, each query's k nearest."""

    def matrix(of):
        """Vectors by length, each as long as 1: (ids, matrix)."""
        by_length: dict[int, tuple[list, list]] = {}
        for i, v in of:
            if i is not None and v is not None and None not in v:
                ids, vs = by_length.setdefault(len(v), ([], []))
                ids.append(i)
                vs.append(v)
        for n, (ids, vs) in by_length.items():
            m = np.array(vs, float).reshape(len(vs), n)
            norm = np.sqrt((m * m).sum(axis=1))
            some = np.isfinite(norm) & (norm > 0)
            yield n, np.array(ids, np.int64)[some], m[some] / norm[some, None]

    def near(batches):
        wanted = {n: (ids, m) for n, ids, m in matrix(queries)}
        for batch in batches:
            for low in range(0, batch.num_rows, rows):
                some = batch.slice(low, rows)
                for n, ids, m in matrix(zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)):
                    q_ids, q = wanted.get(n, (ids[:0], m[:0]))
                    for at in range(0, len(q_ids), many):
                        c = q[at : at + many] @ m.T
                        score = np.floor(c * 1e9 + 0.5).astype(np.int64)
                        own = q_ids[at : at + many, None] == ids[None, :]
                        score[own] = -np.iinfo(np.int64).max
                        i, j = np.arange(len(c))[:, None], np.lexsort((np.broadcast_to(ids, c.shape), -score), axis=1)[:, :k]
                        i, j = (x[~own[i, j]] for x in np.broadcast_arrays(i, j))
                        yield pa.RecordBatch.from_arrays([pa.array(q_ids[at + i]), pa.array(ids[j]), pa.array(score[i, j]), pa.array(c[i, j])], names=["q", "id", "near", "c"])

    return near
