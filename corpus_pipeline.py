"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

The last stage returns packed pieces, the others the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import decontaminate, minhash, packing, queries, suffix, toxicity
from terrane.llm.common import MADE, Written, tidy, unused, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.7. Null and empty texts have the score of no evidence; repeated rows and
    null ids are judged each; all columns stay, whatever their names; no rows give none."""
    names = unused(docs, "score"), unused(docs, "spans")
    scored = toxicity.score(docs, queries.toxicity_model(spark, docs, sf_dir), names=names)
    return scored.where(F.col(names[0]) < 0.7).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the document with the smallest id.

    Of repeated rows, with equal id and text, one stays; rows of one id are one document otherwise, too. So does one of
    rows without an id and with equal texts. Null and empty texts are near nothing. All columns stay, whatever their
    names; no rows give none."""
    found = minhash.near_duplicates(docs, k=5, percent=80)
    odd = found.groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("doc_id is null or n > 1 or not kept")
    odd = written(odd, "stage-odd")
    # Most rows only pass the ids that are odd; none but the repeated ones are compared with each other.
    once = docs.where("doc_id is not null").join(odd.select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    text, (ident, *names) = F.coalesce(F.col("text").cast("string"), F.lit("")), (unused(docs, c) for c in ("id", "digest", "digest2"))
    several = odd.where("kept or doc_id is null").select(F.col("doc_id").alias(ident))
    more = docs.join(several, F.col("doc_id").eqNullSafe(F.col(ident)), "left_semi")
    more = more.withColumns({n: F.xxhash64(text, F.lit(k)) for k, n in enumerate(names)}).dropDuplicates(["doc_id", *names])
    return once.unionByName(more.select(docs.columns))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings (100 and longer) that also start earlier in the corpus; see
    suffix.without_repeats for odd rows."""
    return suffix.without_repeats(docs, length=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (five words, 0.8). Null and empty texts hold none; repeated rows and null
    ids are judged each; all columns stay, whatever their names; no rows give none."""
    name = unused(docs, "matches")
    marked = decontaminate.with_matches(docs, queries.table(spark, sf_dir, "benchmark"), name=name)
    return marked.where(decontaminate.clean(name)).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents in sequences of at most 1024 tokens; see packing.pack_documents for odd rows."""
    packed = packing.pack_documents(docs, queries.tokenizer_path(), max_len=1024, end_id=2)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Learned scores, hashing and packing have no SQL form; the pipeline is tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = len(MADE)
        docs = Written(stage(spark, docs, sf_dir), f"stage-{name}").df
        tidy(before, keep=docs)  # what the stage wrote on its way
    return STAGES[-1][1](spark, docs, sf_dir)
