"""Document quality: a text classifier's evidence with hierarchical empirical Bayes over sites and their parts."""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written

FEATURES = ("symbols", "capitals", "digits", "log_words", "word_letters", "distinct_words", "distinct_lines", "lines", "bars")


def share_of(letters: str) -> Column:
    return (F.length("text") - F.length(F.translate("text", letters, ""))) / F.greatest(F.length("text"), F.lit(1))


def features() -> list[Column]:
    """FEATURES of the column text, all 0 to about 5."""
    words, lines = F.split(F.lower("text"), r"\s+"), F.split("text", "\n")
    n_words = F.size(words)
    return [
        share_of("$#%&*!?@^~<>{}[]=+\\").alias("symbols"),
        share_of(string.ascii_uppercase).alias("capitals"),
        share_of(string.digits).alias("digits"),
        (F.log1p(n_words) / 5).alias("log_words"),
        (F.length("text") / n_words / 10).alias("word_letters"),
        (F.size(F.array_distinct(words)) / n_words).alias("distinct_words"),
        (F.size(F.array_distinct(lines)) / F.size(lines)).alias("distinct_lines"),
        (F.size(lines) / n_words).alias("lines"),
        share_of("|").alias("bars"),
    ]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 100) -> np.ndarray:
    theta = np.zeros(x.shape[1])
    value = lambda t: (y * (x @ t) - np.logaddexp(0, x @ t)).sum() - ridge / 2 * t @ t
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(theta)), x.T @ (y - p) - ridge * theta)
        while value(theta + step) < value(theta) and np.abs(step).max() > 1e-9:
            step = step / 2
        theta = theta + step
    return theta


def expanded(x: np.ndarray) -> np.ndarray:
    return np.concatenate((x, np.sqrt(np.maximum(x, 0)), np.ones((len(x), 1))), axis=1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = 8000, usable=None) -> list[float] | None:
    """Weights of the features, their roots, and 1, from at most most_rows labelled documents, chosen by a hash of
    doc_id; None if there aren't both labels. Only features reach the driver."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    rows = rows if usable is None else rows.where(usable)
    ids = rows.groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    got = docs.where("text is not null").join(F.broadcast(ids), "doc_id").select("doc_id", "label", *features()).collect()
    y = np.array([float(r.label > 0) for r in sorted(got)])
    if not len(y) or y.min() == y.max():
        return None
    x = np.array([[r[f] for f in FEATURES] for r in sorted(got)], float)
    return logistic(expanded(x), y).tolist()


def evidence(weights: list[float] | None) -> Column:
    """Log odds from a row's FEATURES."""
    if weights is None:
        return F.lit(0.0)
    n = len(FEATURES)
    total = F.lit(weights[-1])
    for i, f in enumerate(FEATURES):
        total = total + F.col(f) * weights[i] + F.sqrt(F.greatest(F.col(f), F.lit(0.0))) * weights[n + i]
    return F.greatest(F.least(total, F.lit(20.0)), F.lit(-20.0))


def worth(groups: DataFrame, prior: Column) -> float:
    """How many documents a prior is worth to groups (n, mean, noise), by moments: the wider the groups' true means
    differ, beyond what their sizes explain, the less it is."""
    total = groups.agg(
        F.sum(F.col("n") * (F.col("mean") - prior) ** 2).alias("spread"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("noise")).alias("within")
    ).first()
    n, k = float(total["n"] or 0), float(total["k"] or 0)
    within = (total["within"] or 0.0) / n if n else 0.0
    between = max(1e-6, ((total["spread"] or 0.0) - within * k) / n) if n else 1e-6
    return max(1.0, within / between)


def score(docs: DataFrame, weights: list[float] | None, host: str = "source", part: str = "lang", at: float = 0.5) -> DataFrame:
    """Rows (doc_id, evidence, host_rate, part_rate, score, kept) for every document.

    The classifier's mean probability of a host's other documents, over all of them, is shrunk toward the global mean,
    and that of the other documents of its part (path) of the host toward the host's; sparse ones go furthest. A
    document's log odds are its own evidence plus those by which its part's rate is above the global one; its own
    evidence takes no part in these rates. kept: score of at or more.

    Null and empty texts have no evidence of their own and score by their part's rate; very long ones are read whole.
    Null hosts and parts are groups of their own. Repeated rows and null ids count each; an empty table gives no rows;
    other columns aren't read. Groups' sums combine before the shuffle, and rates come back by a join that Spark may split.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.col(host).cast("string").alias("__host"), F.col(part).cast("string").alias("__part"))
    own = own.select("doc_id", "__host", "__part", (F.length("text") > 0).alias("some"), *features())
    own = Written(own.select("doc_id", "__host", "__part", F.when(F.col("some"), evidence(weights)).otherwise(0.0).alias("evidence")), "quality").df
    p = 1 / (1 + F.exp(-F.col("evidence")))
    parts = own.groupBy("__host", "__part").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("sum"), F.sum(p * p).alias("squares"))
    parts = Written(parts, "quality-parts").df
    hosts = parts.groupBy(F.col("__host").alias("h")).agg(*(F.sum(c).alias(f"host_{c}") for c in ("n", "sum", "squares")))
    every = hosts.agg(F.sum("host_sum") / F.sum("host_n")).first()[0]
    mean = 0.5 if every is None else every
    shape = lambda pre: (F.col(f"{pre}n").alias("n"), (F.col(f"{pre}sum") / F.col(f"{pre}n")).alias("mean"), F.greatest(F.lit(0.0), F.col(f"{pre}squares") / F.col(f"{pre}n") - (F.col(f"{pre}sum") / F.col(f"{pre}n")) ** 2).alias("noise"))
    of_host = worth(hosts.select(*shape("host_")), F.lit(mean))
    both = parts.join(hosts, F.col("__host").eqNullSafe(F.col("h"))).drop("h")
    whole = (F.col("host_sum") + of_host * F.lit(mean)) / (F.col("host_n") + of_host)
    of_part = worth(both.select(*shape(""), whole.alias("prior")), F.col("prior"))
    sums = both.select(F.col("__host").alias("h"), F.col("__part").alias("q"), "n", "sum", "host_n", "host_sum")
    rows = own.join(sums, F.col("__host").eqNullSafe(F.col("h")) & F.col("__part").eqNullSafe(F.col("q")))
    rows = rows.withColumn("host_rate", (F.col("host_sum") - p + of_host * F.lit(mean)) / (F.col("host_n") - 1 + of_host))
    rows = rows.withColumn("part_rate", (F.col("sum") - p + of_part * F.col("host_rate")) / (F.col("n") - 1 + of_part))
    held = lambda c: F.greatest(F.least(c, F.lit(1 - 1e-6)), F.lit(1e-6))
    odds = lambda c: F.log(held(c) / (1 - held(c)))
    z = F.col("evidence") + odds(F.col("part_rate")) - odds(F.lit(mean))
    scored = rows.select("doc_id", "evidence", "host_rate", "part_rate", (1 / (1 + F.exp(-z))).alias("score"))
    return scored.withColumn("kept", F.col("score") >= at)
