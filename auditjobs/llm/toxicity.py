"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier on its posteriors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import pick
from ._memory import lean
from ._text import hashes, mix, runs, spans, sums

#: Labelled documents to fit on, at most, by label; chosen by a hash of their id.
FIT_TOXIC, FIT_CLEAN = 2500, 4000
#: Features of the classifier, and induced voters of the label model.
FEATURES, INDUCED = 2000, 80
#: Words and stems of insults that vote from the start; more voters are induced from the labels.
LEXICON = (
    "idiot idiots moron stupid dumb loser losers scum trash garbage clown pathetic worthless disgusting filthy ugly "
    "imbécile idiote connard ordure crétin stupide dumm dummkopf abschaum müll idiota estúpido basura imbécil asqueroso"
).split()
#: Lengths of the word beginnings, in bytes, that serve as patterns.
BEGINNINGS = (4, 5, 6, 7, 8)

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _hash_spans(prefix, starts, ends, kind: int) -> np.ndarray:
    return mix(hashes(prefix, starts, ends) + np.uint64(kind)).view(np.int64)


def feature_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, rows, words of each row): whole words and word beginnings of lower-cased text."""
    starts, ends, rows = spans(~_LETTER[data], offsets)
    prefix = sums(data)
    found, at = [_hash_spans(prefix, starts, ends, 0)], [rows]
    for k in BEGINNINGS:
        longer = ends - starts > k
        found.append(_hash_spans(prefix, starts[longer], starts[longer] + k, k))
        at.append(rows[longer])
    return np.concatenate(found), np.concatenate(at), np.bincount(rows, minlength=len(offsets) - 1)


def _distinct(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((rows, h))
    h, rows = h[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return h[new], rows[new]


def _folded(column):
    return pc.utf8_lower(column.cast(pa.large_string()))


def _counts(stream):
    for batch in stream:
        label = batch.column(0).to_numpy()
        for lo, data, offsets in runs(_folded(batch.column(1))):
            h, rows = _distinct(*feature_hashes(data, offsets)[:2])
            if not len(h):
                continue
            names, which = np.unique(h, return_inverse=True)
            toxic = np.bincount(which, weights=label[lo + rows]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array(toxic), pa.array(np.bincount(which) - toxic)], ["feature", "toxic", "clean"]
            )


def _present(chosen: np.ndarray, data, offsets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature numbers, rows, words): which of the sorted chosen features each row holds, once each."""
    h, rows, words = feature_hashes(data, offsets)
    at = np.minimum(np.searchsorted(chosen, h), max(len(chosen) - 1, 0))
    hit = chosen[at] == h if len(chosen) else np.zeros(len(h), bool)
    number, rows = _distinct(at[hit], rows[hit])
    return number, rows, words


@dataclass
class Model:
    """Sorted feature hashes with their weights, the weight of log(1 + words), and the intercept."""

    features: np.ndarray
    weights: np.ndarray
    length: float
    intercept: float

    def scores(self, data, offsets) -> np.ndarray:
        number, rows, words = _present(self.features, data, offsets)
        z = np.bincount(rows, weights=self.weights[number] if len(number) else None, minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(z + self.length * np.log1p(words) + self.intercept, -30, 30)))


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 10, shrink: float = 0.1) -> np.ndarray:
    """Posterior of being toxic for each row.

    votes: 1 where a voter fires, 0 where it abstains. The given labels are one
    more voter whose accuracy is estimated like the others'. The model is
    generative: a class, and votes around the class means with a covariance
    shared by the classes, so voters that fire together (a word and its
    beginning) are not counted twice. Fitted by expectation-maximisation from
    the given labels; ``shrink`` pulls the covariance to its diagonal.
    """
    v = np.concatenate([votes, given[:, None]], axis=1).astype(np.float64)
    p = np.clip(given.astype(float), 0.05, 0.95)
    for _ in range(rounds):
        share = np.clip(p.mean(), 1e-3, 1 - 1e-3)
        one = (p[:, None] * v).sum(0) / p.sum()
        zero = ((1 - p)[:, None] * v).sum(0) / (1 - p).sum()
        a, b = v - one, v - zero
        spread = ((p[:, None] * a).T @ a + ((1 - p)[:, None] * b).T @ b) / len(v)
        spread = (1 - shrink) * spread + np.diag(shrink * np.diag(spread) + 0.01)
        w = np.linalg.solve(spread, one - zero)
        z = (v - (one + zero) / 2) @ w + np.log(share / (1 - share))
        p = 1 / (1 + np.exp(-np.clip(z, -20, 20)))
    return p


def logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, steps: int = 300) -> np.ndarray:
    """Weights of a logistic regression on probabilities, by Adam."""
    theta = np.zeros(x.shape[1], np.float32)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    weight = weight / weight.sum()
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ (weight * (target - p)) - ridge * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return theta


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most_toxic: int = FIT_TOXIC, most_clean: int = FIT_CLEAN) -> Model:
    """A model fitted on a bounded sample of the labelled documents for which ``may_learn`` (on the id column) holds.

    Features are counted in Spark over the whole texts of the sample; the best
    ``FEATURES`` come to the driver, then each document's few of them. Of rows that share
    an id, the least label and the least text count. Without labels of both kinds, or with empty tables, every score is 0.
    """
    known = pick(labels.filter(may_learn), doc_id=id_col, label=label_col).filter("doc_id is not null and label is not null")
    known = known.groupBy("doc_id").agg((F.min("label") > 0).cast("int").alias("label"))
    sample = lambda kind, n: known.filter(F.col("label") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = sample(1, most_toxic).unionByName(sample(0, most_clean))
    found = pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(chosen), "doc_id")
    texts = found.groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text")).select("label", "text").persist()
    try:
        sizes = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        if len(sizes) < 2:
            return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, -30.0)
        counted = (
            texts.mapInArrow(lean(_counts), "feature long, toxic long, clean long")
            .groupBy("feature")
            .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
            .filter(F.col("toxic") + F.col("clean") >= 4)
        )
        n = sizes[0] + sizes[1]
        held = F.col("toxic") + F.col("clean")

        def surplus(count, kind):
            return F.when(count > 0, count * F.log(count * n / (held * sizes[kind]))).otherwise(0.0)

        gain = surplus(F.col("toxic"), 1) + surplus(F.col("clean"), 0)  # half the log-likelihood ratio of the feature and the label
        sign = F.when(F.col("toxic") * sizes[0] > F.col("clean") * sizes[1], 1.0).otherwise(-1.0)
        rated = counted.select("feature", "toxic", "clean", (sign * gain).alias("z"))
        best = rated.filter((F.col("z") > 5) & (F.col("toxic") >= 2 * F.col("clean"))).orderBy(F.desc("z"), "feature").limit(FEATURES).collect()
        lexicon = [int(feature_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0][0]) for w in LEXICON]
        induced = [r["feature"] for r in best if r["toxic"] >= 4 * r["clean"]][:INDUCED]
        features = np.unique(np.array([r["feature"] for r in best] + lexicon, np.int64))

        def present(stream):
            for batch in stream:
                for lo, data, offsets in runs(_folded(batch.column(1))):
                    number, rows, words = _present(features, data, offsets)
                    order = np.argsort(rows, kind="stable")
                    at = np.searchsorted(rows[order], np.arange(len(words) + 1))
                    held = [number[order[i:j]].astype("<i4").tobytes() for i, j in zip(at, at[1:])]
                    yield pa.RecordBatch.from_arrays([batch.column(0)[lo : lo + len(words)], pa.array(words), pa.array(held, pa.binary())], ["label", "words", "held"])

        rows = texts.mapInArrow(lean(present), "label int, words long, held binary").toArrow().sort_by([("label", "ascending"), ("words", "ascending"), ("held", "ascending")])
    finally:
        texts.unpersist()
    given, words = rows.column("label").to_numpy(), rows.column("words").to_numpy()
    x = np.zeros((len(given), len(features) + 2), np.float32)
    for i, held in enumerate(rows.column("held").to_pylist()):
        x[i, np.frombuffer(held, "<i4")] = 1
    x[:, -2], x[:, -1] = np.log1p(words), 1
    voters = np.unique(np.searchsorted(features, np.array(lexicon + induced, np.int64)))
    posterior = label_model(x[:, voters], given)
    share = np.clip(posterior.mean(), 1e-3, 1 - 1e-3)
    both_alike = (posterior * 0.5 / share + (1 - posterior) * 0.5 / (1 - share)).astype(np.float32)
    theta = logistic(x, posterior.astype(np.float32), both_alike)
    return Model(features, theta[:-2].astype(float), float(theta[-2]), float(theta[-1]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: one narrow pass over whole texts. Null and empty texts score as texts without words."""

    def batches(stream):
        for batch in stream:
            out = np.zeros(batch.num_rows)
            for lo, data, offsets in runs(_folded(batch.column(1))):
                out[lo : lo + len(offsets) - 1] = model.scores(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "score"])

    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(lean(batches), f"doc_id {dict(docs.dtypes)[id_col]}, score double")
