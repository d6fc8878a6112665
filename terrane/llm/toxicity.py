"""Toxic spans by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, unused
from .shingles import mix

BUCKETS = 1 << 22
SIZES = (4, 5, 6, 8)  # bytes of a word's parts
EDGES = bytes(b for b in range(128) if not chr(b).isalnum())
MOST_CACHED = 300_000
MOST_LETTERS = 1_000_000  # of the texts tagged at once (more where one text has more)
MOST_TOKENS = 1_000_000  # of the texts that calibrate at once (more where one text has more)


def parts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The words' features, all at once: (word's number, bucket) of each word itself, and of each byte string of SIZES
    in it, with marked ends and without punctuation around. A string that a word has twice counts twice."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = [b"^" + w.encode().strip(EDGES) + b"$" for w in words]
    sizes = np.array([len(m) for m in marked])
    ends = np.cumsum(sizes)
    b = np.frombuffer(b"".join(marked) + bytes(8), np.uint8).astype(np.uint64)
    wide = {1: b}
    for k in (1, 2, 4):
        wide[2 * k] = wide[k][:-k] | (wide[k][k:] << np.uint64(8 * k))
    n = int(ends[-1])
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(ends, sizes) - np.arange(n)  # bytes from here to the word's end
    rows, hashes = [np.arange(len(words))], [np.fromiter(map(zlib.crc32, marked), np.uint64, len(marked))]
    for size in SIZES:
        at = np.flatnonzero(left >= size)
        gram = wide[8][at] if size == 8 else wide[4][at] | (wide[{5: 1, 6: 2}[size]][at + 4] << np.uint64(32)) if size > 4 else wide[4][at]
        rows.append(word[at])
        hashes.append(mix(gram * np.uint64(31) + np.uint64(size)))
    return np.concatenate(rows), (np.concatenate(hashes) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class Model:
    """Weights of the buckets that count, the chain's potentials, and the calibration of document scores."""

    base_rate: float = 0.0
    weights: dict[int, float] = field(default_factory=dict)
    bias: float = 0.0
    stay_clean: float = 0.0
    enter: float = 0.0
    leave: float = 0.0
    stay_toxic: float = 0.0
    calibration: tuple[float, ...] = ()

    def score(self, evidence: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(evidence), self.base_rate)
        return 1 / (1 + np.exp(-np.clip(evidence @ np.array(self.calibration), -30, 30)))


class Odds(dict):
    """exp of a word's potential for being toxic rather than clean; new words are worked out together."""

    def __init__(self, model: Model):
        super().__init__()
        self.bias = model.bias
        self.buckets = np.array(sorted(model.weights), np.int64)
        self.weights = np.array([model.weights[b] for b in sorted(model.weights)])
        self.counts = np.zeros(BUCKETS, bool)
        self.counts[self.buckets] = True

    def of(self, words: list[list[str]]) -> np.ndarray:
        if len(self) > MOST_CACHED:
            self.clear()
        new = list(set().union(*words).difference(self))
        rows, buckets = parts(new)
        rows, buckets = rows[self.counts[buckets]], buckets[self.counts[buckets]]
        e = self.bias + np.bincount(rows, self.weights[np.searchsorted(self.buckets, buckets)], len(new))
        self.update(zip(new, np.exp(np.minimum(30.0, e)).tolist(), strict=True))
        return np.concatenate([np.fromiter(map(self.__getitem__, ws), float, len(ws)) for ws in words]) if len(words) else np.zeros(0)


def by_step(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts laid end to end: each token's place if all texts' first tokens come first, then all second ones, the
    longest text first; and where each step starts."""
    order = np.argsort(-lengths, kind="stable")
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths))
    live = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")  # texts longer than t
    at = np.concatenate((np.zeros(1, np.int64), np.cumsum(live)))
    t = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return at[t] + np.repeat(rank, lengths), at


@dataclass
class Passes:
    """Forward and backward messages, each the ratio of its two states, of all texts at once, step by step."""

    z: np.ndarray
    forth: np.ndarray
    back: np.ndarray
    place: np.ndarray
    at: np.ndarray


def passes(odds: np.ndarray, lengths: np.ndarray, model: Model) -> Passes:
    place, at = by_step(lengths)
    z = np.empty(len(odds))
    z[place] = odds
    a, b, c, d = (np.exp(v) for v in (model.enter, model.stay_toxic, model.stay_clean, model.leave))
    forth, back, r = np.empty(len(z)), np.ones(len(z)), None
    bounds = at.tolist()
    for i, j in zip(bounds, bounds[1:], strict=False):
        r = z[i:j] * (a / c) if r is None else z[i:j] * (a + b * r[: j - i]) / (c + d * r[: j - i])
        forth[i:j] = r = np.minimum(r, 1e30)
    for t in range(len(bounds) - 3, -1, -1):
        i, j, k = bounds[t : t + 3]
        s = z[j:k] * back[j:k]
        back[i : i + k - j] = (d + b * s) / (c + a * s)
    return Passes(z, forth, back, place, at)


def marginals(got: Passes) -> np.ndarray:
    """Each token's probability of being toxic."""
    both = got.forth * got.back
    return (both / (1 + both))[got.place]


def evidence(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A row for each text, from its tokens' probabilities: log odds that it has a toxic token (at most 20 either way,
    in tens), the expected number of them (as a logarithm) and their share (as a root), and 1."""
    sums = lambda v: np.concatenate((np.zeros(1), np.cumsum(v)))
    ends = np.cumsum(lengths)
    of = lambda v: sums(v)[ends] - sums(v)[ends - lengths]
    none = np.exp(np.minimum(0, of(np.log1p(-np.minimum(p, 1 - 1e-9)))))
    odds = np.clip(np.log((1 - none + 1e-9) / (none + 1e-9)), -20, 20)
    many = np.maximum(0, of(p))
    return np.stack((odds / 10, np.log1p(many), np.sqrt(many / np.maximum(lengths, 1)), np.ones(len(lengths))), axis=1)


class Chains:
    """Whole texts as units for fitting: a run of tokens without features, which all have one potential, and the token
    with features that ends it, if any does. What a run of any length expects has a closed form, so that the work
    follows the tokens with features.

    States are clean and toxic; vectors over them are kept as the ratio of the second to the first.
    """

    def __init__(self, words: list[np.ndarray], toxic: np.ndarray, hit: np.ndarray):
        gaps, ids, labels, lengths = [], [], [], []
        for ws, y in zip(words, toxic, strict=True):
            at = np.flatnonzero(hit[ws]) if len(ws) else np.zeros(0, np.int64)
            gaps.append(np.diff(np.concatenate(([-1], at, [len(ws)]))) - 1)
            ids.append(np.append(ws[at], -1))
            labels.append(np.append(np.full(len(at), int(bool(y))), 0))
            lengths.append(len(at) + 1)
        place, self.at = by_step(np.array(lengths, np.int64))
        self.gap, self.id, self.y = (np.empty(len(place), t) for t in (float, np.int64, np.int64))
        gap, y = np.concatenate(gaps), np.concatenate(labels)
        self.gap[place], self.id[place], self.y[place] = gap, np.concatenate(ids), y
        self.ends = self.id < 0  # the last unit of a text has no token with features
        first = np.zeros(len(y), bool)
        first[np.cumsum(lengths) - lengths] = True
        before = np.where(first, 0, np.append(0, y[:-1]))  # the label of the token before a unit
        token = np.concatenate(ids) >= 0
        open_, none = before * (gap == 0), before * (gap > 0)
        up, on, down = (token & (y == 1) & (open_ == 0)).sum(), (token & (y == 1) & (open_ == 1)).sum(), none.sum() + (token & (y == 0) & (open_ == 1)).sum()
        self.seen = np.array([up, on, down, gap.sum() + token.sum() - up - on - down], float)

    def expected(self, odds: np.ndarray, plain: float, model: Model) -> tuple[np.ndarray, float, np.ndarray]:
        """Each unit's token's probability of being toxic (0 without one), the sum of those of plain tokens, and the
        expected numbers of steps clean-toxic, toxic-toxic, toxic-clean and clean-clean. odds are the units' tokens'."""
        a, b, c, d = (np.exp(v) for v in (model.enter, model.stay_toxic, model.stay_clean, model.leave))
        root = np.sqrt((c - b * plain) ** 2 + 4 * a * plain * d)
        l1, l2 = (c + b * plain + root) / 2, (c + b * plain - root) / 2
        vectors = np.array([[a * plain, a * plain], [l1 - c, l2 - c]])
        inverse, r = np.linalg.inv(vectors), l2 / l1
        fade = np.power(r, self.gap)  # the second eigenvalue's share after a run
        begin, mid, after = np.empty(len(odds)), np.empty(len(odds)), np.ones(len(odds))
        bounds, out = self.at.tolist(), None
        for i, j in zip(bounds, bounds[1:], strict=False):
            begin[i:j] = 0.0 if out is None else out[: j - i]
            one, two = (vectors[0, k] + vectors[1, k] * begin[i:j] for k in (0, 1))
            two = two * fade[i:j]
            mid[i:j] = (one * inverse[0, 1] + two * inverse[1, 1]) / (one * inverse[0, 0] + two * inverse[1, 0])
            out = np.minimum(odds[i:j] * (a + b * mid[i:j]) / (c + d * mid[i:j]), 1e30)
        end = np.ones(len(odds))  # backward, between a run and its token
        for t in range(len(bounds) - 2, -1, -1):
            i, j = bounds[t : t + 2]
            if t < len(bounds) - 2:
                k = bounds[t + 2]
                one, two = (inverse[n, 0] + inverse[n, 1] * end[j:k] for n in (0, 1))
                two = two * fade[j:k]
                after[i : i + k - j] = (vectors[1, 0] * one + vectors[1, 1] * two) / (vectors[0, 0] * one + vectors[0, 1] * two)
            s = odds[i:j] * after[i:j]
            end[i:j] = np.where(self.ends[i:j], 1.0, (d + b * s) / (c + a * s))
        s = odds * after
        four = np.stack((a * s, b * mid * s, d * mid, np.full(len(odds), c))) * ~self.ends
        four /= np.where(self.ends, 1.0, four.sum(axis=0))
        # Runs: left and right in the eigenvectors' coordinates, and the sums over all places in the run.
        left = [vectors[0, k] + vectors[1, k] * begin for k in (0, 1)]
        right = [inverse[k, 0] + inverse[k, 1] * end for k in (0, 1)]
        whole = left[0] * right[0] + fade * left[1] * right[1]
        apart = (1 - fade) / (l1 - l2)
        twice = self.gap * np.where(self.gap > 0, np.power(r, np.maximum(self.gap - 1, 0)), 0.0) / l1
        sums = [[self.gap / l1, apart], [apart, twice]]
        steps = np.array([[c, a * plain], [d, b * plain]])
        runs = np.array([[sum((left[p] * right[q] * sums[p][q] / whole).sum() * inverse[p, m] * vectors[n, q] for p in (0, 1) for q in (0, 1)) for n in (0, 1)] for m in (0, 1)]) * steps
        return four[0] + four[1], runs[0, 1] + runs[1, 1], four.sum(axis=1) + np.array([runs[0, 1], runs[1, 1], runs[1, 0], runs[0, 0]])


def fit(texts: list[str], toxic: np.ndarray, p_value: float = 1e-8, rounds: int = 100) -> Model:
    """Learns from whole labelled texts. A token is labelled toxic if it has a feature whose presence goes with toxic
    texts (more than 0.6 of its texts are toxic, at twice the odds of all texts or more; its chance among texts labelled alike
    is under p_value) and its text is toxic; the others are clean."""
    model = Model(base_rate=float(toxic.mean()) if len(toxic) else 0.0)
    if not 0 < model.base_rate < 1:
        return model
    # Words as numbers: a list of strings for each text would outgrow the driver.
    number: dict[str, int] = {}
    words = [np.fromiter((number.setdefault(w, len(number)) for w in t.lower().split()), np.int32) for t in texts]
    flat, ends, every = array("i"), [np.zeros(1, np.int64)], list(number)  # all words' buckets, laid end to end
    for i in range(0, len(every), 20_000):
        some = every[i : i + 20_000]
        row, bucket = parts(some)
        flat.frombytes(bucket[np.argsort(row, kind="stable")].astype(np.int32).tobytes())
        ends.append(ends[-1][-1] + np.cumsum(np.bincount(row, minlength=len(some))))
    ends = np.concatenate(ends)
    del every
    n_words, flat = len(number), np.frombuffer(flat, np.int32)
    del number
    counts = np.zeros((2, BUCKETS), np.int32)
    for ws, y in zip(words, toxic, strict=True):
        if len(ws):
            counts[int(y)][np.unique(np.concatenate([flat[ends[w] : ends[w + 1]] for w in np.unique(ws)]))] += 1
    some = np.flatnonzero(counts[1])
    toxic_n, n = counts[1][some], counts[:, some].sum(axis=0)
    del counts
    q, p0 = toxic_n / n, model.base_rate
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.nan_to_num(q * np.log(q / p0)) + np.nan_to_num((1 - q) * np.log((1 - q) / (1 - p0)))
    likelier = q * (1 - p0) > 2 * p0 * (1 - q)  # twice the odds of all texts: can be met at every base rate
    chosen = some[(q > 0.6) & likelier & (n * gain > -np.log(p_value))]
    if not len(chosen):
        return model
    slot = np.full(BUCKETS, -1, np.int32)
    slot[chosen] = np.arange(len(chosen))
    cols = slot[flat]
    rows = np.repeat(np.arange(n_words, dtype=np.int32), np.diff(ends))[cols >= 0]
    cols = cols[cols >= 0]
    del flat, slot
    hit = np.zeros(n_words, bool)
    hit[rows] = True
    chains = Chains(words, np.asarray(toxic), hit)
    token = ~chains.ends
    ids, y = chains.id[token], chains.y[token]
    theta = np.zeros(len(chosen) + 5)  # weights, bias, enter, stay_toxic, leave, stay_clean
    theta[-5] = -3.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    x = np.ones(len(chains.id))
    for k in range(1, rounds + 1):
        w = theta[:-5]
        e = theta[-5] + np.bincount(rows, w[cols], n_words)
        now = Model(bias=0, enter=theta[-4], stay_toxic=theta[-3], leave=theta[-2], stay_clean=theta[-1])
        x[token] = np.exp(np.clip(e[ids], -30, 30))
        p, plain, pairs = chains.expected(x, float(np.exp(theta[-5])), now)
        p = p[token]
        back = np.bincount(ids, y - p, n_words)
        grad = np.concatenate((np.bincount(cols, back[rows], len(chosen)) - 0.5 * w, [(y - p).sum() - plain], chains.seen - pairs - 0.5 * theta[-4:]))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    model.weights = {int(b): float(x) for b, x in zip(chosen, theta[:-5], strict=True)}
    model.bias, model.enter, model.stay_toxic, model.leave, model.stay_clean = map(float, theta[-5:])
    odds = np.exp(np.minimum(30.0, model.bias + np.bincount(rows, theta[:-5][cols], n_words)))
    z = []
    for group in grouped(words):
        lengths = np.array([len(ws) for ws in group], np.int64)
        z.append(evidence(marginals(passes(odds[np.concatenate(group)], lengths, model)), lengths))
    z = np.concatenate(z)
    model.calibration = calibrated(z, np.asarray(toxic, float))
    return model


def calibrated(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, ...]:
    """A logistic regression of y on the evidence, with a little shrinkage."""
    theta = np.zeros(x.shape[1])
    value = lambda t: (y * (x @ t) - np.logaddexp(0, x @ t)).sum() - 0.05 * t @ t
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(theta))
        step = np.linalg.solve(hess, x.T @ (y - p) - 0.1 * theta)
        while value(theta + step) < value(theta) and np.abs(step).max() > 1e-9:
            step = step / 2
        theta = theta + step
    return tuple(map(float, theta))


def grouped(words: list):
    """Consecutive texts with about MOST_TOKENS tokens together."""
    group, n = [], 0
    for ws in words:
        group.append(ws)
        n += len(ws)
        if n >= MOST_TOKENS:
            yield group
            group, n = [], 0
    if group:
        yield group


def like_lengths(texts: list[str]):
    """Numbers of texts of about one length, with about MOST_LETTERS letters together: only their words are in memory."""
    group, n = [], 0
    for i in sorted(range(len(texts)), key=lambda i: len(texts[i])):
        group.append(i)
        n += len(texts[i])
        if n >= MOST_LETTERS:
            yield group
            group, n = [], 0
    if group:
        yield group


def tagged(words: list[list[str]], model: Model, odds: Odds | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Evidence of each text, its length, and all tokens' probabilities."""
    odds = Odds(model) if odds is None else odds
    lengths = np.array([len(ws) for ws in words], np.int64)
    x = odds.of(words)
    p = marginals(passes(x, lengths, model))
    return evidence(p, lengths), lengths, p


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_rows: int = 8000, usable=None, most_bytes: int = 64_000_000) -> Model:
    """Fits on whole labelled documents, at most most_rows of them and most_bytes of their texts: in the order of a hash
    of doc_id, of the rows of labels that usable (a condition) allows, those that still have room."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    rows = rows if usable is None else rows.where(usable)
    ids = rows.groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)
    own = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(ids), "doc_id")
    sizes = own.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    chosen, room = [], most_bytes
    for r in sizes:
        if r.size <= room:
            chosen.append((r.doc_id,))
            room -= r.size
    texts = own if len(chosen) == len(sizes) else own.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, docs.select("doc_id").schema)), "doc_id")
    got = sorted(map(tuple, texts.select("doc_id", "text", "label").collect()))
    return fit([t for _, t, _ in got], np.array([int(y > 0) for *_, y in got], int))


def score(docs: DataFrame, model: Model, least: float = 0.5, names: tuple[str, str] = ("score", "spans")) -> DataFrame:
    """docs with two columns of these names: a score (double, 0 to 1), and spans (start, end in letters, probability) of
    runs of tokens that are toxic with probability least or more.

    Null and empty texts have no evidence and the score of none. Texts are read whole at any length; repeated rows and
    null ids are scored each; an empty table gives none. Other columns stay; those that have the names are replaced, so
    give others (common.unused finds some) where they should stay, too.
    """
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("probability", T.DoubleType())])

    @lean
    def tag(batches):
        odds = Odds(model)
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            scores, spans = np.full(len(texts), model.score(evidence(np.zeros(0), np.zeros(1, np.int64)))[0]), [[] for _ in texts]
            if model.weights:
                for of in like_lengths(texts):
                    z, lengths, p = tagged([texts[i].lower().split() for i in of], model, odds)
                    scores[of] = model.score(z)
                    ends = np.cumsum(lengths)
                    for k in np.unique(np.searchsorted(ends, np.flatnonzero(p >= least), side="right")):
                        spans[of[k]] = offending(texts[of[k]], p[ends[k] - lengths[k] : ends[k]], least)
            out = [*batch.select(columns).columns, pa.array(scores), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])))]
            yield pa.RecordBatch.from_arrays(out, names=[*columns, *names])

    docs = docs.drop(*names)
    columns = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.ArrayType(span))])
    plain = docs.schema["text"].dataType == T.StringType()
    text = "text" if plain else unused(docs, "text")  # no second copy where none is needed
    return (docs if plain else docs.withColumn(text, F.col("text").cast("string"))).mapInArrow(tag, schema)


def offending(text: str, p: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    out: list[tuple[int, int, float]] = []
    last = -2
    for i, m in enumerate(re.finditer(r"\S+", text)):
        if i < len(p) and p[i] >= least:
            if last == i - 1:
                out[-1] = (out[-1][0], m.end(), max(out[-1][2], float(p[i])))
            else:
                out.append((m.start(), m.end(), float(p[i])))
            last = i
    return out
