"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import Scratch, pick
from ._memory import lean
from ._text import BYTE_VALUES, SEPARATORS, hashes, runs, spans, sums

#: Documents that the field is fitted on, at most. Chosen by a hash of their id among the labelled rows given.
FIT_DOCUMENTS = 6000
#: Lines that the field is fitted on, at most, which bounds what comes to the driver: documents count in the order of the hash until their lines are more.
FIT_LINES = 600_000
#: Features are formed for so many lines at a time.
WINDOW_LINES = 1 << 15

_KINDS = {"upper": 1, "lower": 2, "digit": 3, "mark": 4, "symbol": 5, "pipe": 6, "bang": 7, "beyond": 8}
KIND = np.zeros(256, np.int64)
KIND[33:127] = _KINDS["symbol"]
KIND[65:91] = _KINDS["upper"]
KIND[97:123] = _KINDS["lower"]
KIND[48:58] = _KINDS["digit"]
KIND[[ord(c) for c in ".,;:'\"-()?"]] = _KINDS["mark"]
KIND[ord("|")] = _KINDS["pipe"]
KIND[ord("!")] = _KINDS["bang"]
KIND[128:] = _KINDS["beyond"]
KINDS = 9
OWN = 14


def document_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(where lines start, their lengths without line feeds, first line of each document and the end) of a run of documents.

    A document has one line more than it has line feeds; an empty one has one empty line.
    """
    feeds = np.flatnonzero(data == 10)
    docs = len(offsets) - 1
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    first = np.searchsorted(feeds, offsets) + np.arange(docs + 1)
    # an empty document's only line starts where the next document's first line does: order by document
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:]
    ends -= 1
    ends[first[1:] - 1] = offsets[1:]
    return starts, np.maximum(ends - starts, 0), first


def line_features(data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The OWN features of each of some adjoining lines. data begins with the first and ends with the last."""
    n = len(starts)
    bounds = np.append(starts, len(data))
    line = np.repeat(np.arange(n), np.diff(bounds))
    kinds = np.bincount(line * KINDS + KIND[data], minlength=n * KINDS).reshape(n, KINDS).astype(np.float64)
    word_from, word_to, _ = spans(SEPARATORS[data], bounds)
    of = line[word_from] if len(word_from) else word_from
    words = np.bincount(of, minlength=n).astype(np.float64)
    h = hashes(sums(data, BYTE_VALUES), word_from, word_to)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    repeats = np.bincount(of[same], minlength=n)
    short = np.bincount(of[(word_to - word_from) <= 3], minlength=n)
    some, letters = np.maximum(words, 1), np.maximum(kinds[:, 1] + kinds[:, 2] + kinds[:, 8], 1)
    share = kinds / np.maximum(length, 1)[:, None]
    return np.stack(
        [
            np.ones(n),
            np.log1p(length) / 8,
            np.log1p(words) / 6,
            length == 0,
            kinds[:, 1] / letters,
            share[:, 3] * 5,
            share[:, 4] * 5,
            share[:, 5] * 5,
            np.minimum(kinds[:, 6] / some, 1),
            np.minimum(kinds[:, 7] / some, 2),
            share[:, 8],
            repeats / some,
            short / some,
            np.minimum((length / some) / 10, 3),
        ],
        axis=1,
    )


def windows(data: np.ndarray, starts: np.ndarray, length: np.ndarray, most: int = WINDOW_LINES):
    """(first line, one past the last, their features) for at most so many lines at a time."""
    for a in range(0, len(starts), most):
        b = min(a + most, len(starts))
        lo, hi = starts[a], starts[b] if b < len(starts) else len(data)
        yield a, b, line_features(data[lo:hi], starts[a:b] - lo, length[a:b])


def log_odds(scores: np.ndarray, between: np.ndarray, first: np.ndarray, block: int | None = None) -> np.ndarray:
    """Log-odds of label 1 at each line given the lines up to it, in chains over two labels.

    scores: log potentials of label 1 over label 0; between: (2, 2). Chains are cut in blocks that advance together, a line at a time:
    first the map of each block from the odds before it to those at its end, then the odds along the blocks of a
    chain, then the odds within blocks. A chain of n lines takes about three times its square root in steps.
    """
    out, sizes = scores.copy(), np.diff(first) - 1  # the first line of a chain has nothing before it
    block = block or max(64, int(np.sqrt(sizes.max(initial=0))) + 1)
    count = -(-sizes // block)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    chain = np.repeat(np.arange(len(sizes)), count)
    start = first[:-1][chain] + 1 + place * block
    length = np.minimum(block, sizes[chain] - place * block)
    order = np.argsort(-length, kind="stable")
    before = scores[start - 1]  # right for the first block of a chain

    def lines(blocks):
        longest = length[blocks]
        for t in range(int(longest[0]) if len(blocks) else 0):
            now = blocks[: np.searchsorted(-longest, -t, "left")]
            yield now, start[now] + t

    if len(count) and count.max() > 1:
        maps = np.zeros((2, 2, len(start)))  # log weight of (label before the block, label now)
        maps[0, 1] = maps[1, 0] = -np.inf
        for now, at in lines(order[place[order] + 1 < count[chain[order]]]):
            m = maps[:, :, now]
            new = np.stack([np.stack([np.logaddexp(m[i, 0] + between[0, j], m[i, 1] + between[1, j]) for j in (0, 1)]) for i in (0, 1)])
            new[:, 1] += scores[at]
            maps[:, :, now] = new - new.max(axis=(0, 1))
        by_place = np.argsort(place, kind="stable")
        for now in np.split(by_place, np.cumsum(np.bincount(place))[:-1])[1:]:
            m, r = maps[:, :, now - 1], before[now - 1]
            before[now] = np.logaddexp(m[0, 1], m[1, 1] + r) - np.logaddexp(m[0, 0], m[1, 0] + r)
    (b00, b01), (b10, b11) = between
    for now, at in lines(order):
        r = before[now]
        before[now] = out[at] = scores[at] + np.logaddexp(b01, b11 + r) - np.logaddexp(b00, b10 + r)
    return out


def good_marginals(scores: np.ndarray, between: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Probability of label 1 at each line, by :func:`log_odds` from both ends."""
    n = len(scores)
    odds = log_odds(scores, between, first)
    odds += log_odds(scores[::-1].copy(), between.T, n - first[::-1])[::-1]
    odds -= scores
    return 0.5 + 0.5 * np.tanh(odds / 2)


def forward_backward(scores: np.ndarray, between: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(line marginals, summed transition marginals, log partition) of chains over two labels.

    scores: log potentials (lines, 2); between: (2, 2). All chains advance together, position by position.
    """
    chains = np.argsort(-np.diff(first), kind="stable")
    length, start = np.diff(first)[chains], first[:-1][chains]
    longest = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(longest), "left")  # chains longer than t
    forward, backward = scores.copy(), np.zeros_like(scores)
    for t in range(1, longest):
        at = start[: active[t]] + t
        forward[at] += np.logaddexp.reduce(forward[at - 1][:, :, None] + between, axis=1)
    for t in range(longest - 2, -1, -1):
        at = start[: active[t + 1]] + t
        backward[at] = np.logaddexp.reduce(between + (scores[at + 1] + backward[at + 1])[:, None, :], axis=2)
    total = np.logaddexp.reduce(forward[start + length - 1], axis=1) if longest else np.zeros(0)
    each = np.empty(len(total))
    each[chains] = total
    marginals = np.exp(forward + backward - np.repeat(each, np.diff(first))[:, None])
    inner = np.ones(len(scores), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    whole = np.repeat(each, np.diff(first))[at]
    moves = np.exp(forward[at - 1][:, :, None] + between + (scores[at] + backward[at])[:, None, :] - whole[:, None, None]).sum(axis=0)
    return marginals, moves, float(total.sum())


def fit(features: np.ndarray, first: np.ndarray, good: np.ndarray, steps: int = 200, ridge: float = 0.5) -> np.ndarray:
    """Weights of the field: emission of the good label, then the 2 x 2 transitions.

    A document's label is the label of its lines. Gradients are exact
    (forward-backward); steps are Adam's on the mean over documents, both classes weighing alike.
    """
    docs = len(first) - 1
    sizes = np.diff(first)
    label = np.repeat(good, sizes).astype(int)
    share = np.clip(good.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(good, 0.5 / share, 0.5 / (1 - share))
    groups = [np.flatnonzero(good == v) for v in (False, True)]
    theta = np.zeros(features.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    pick_rows = [np.concatenate([np.arange(first[d], first[d + 1]) for d in g]) if len(g) else np.zeros(0, int) for g in groups]
    bounds = [np.concatenate([[0], np.cumsum(sizes[g])]) for g in groups]
    for step in range(1, steps + 1):
        gradient = -ridge * theta / docs
        for value, (rows, at, g) in enumerate(zip(pick_rows, bounds, groups)):
            if not len(g):
                continue
            x = features[rows]
            scores = np.stack([np.zeros(len(rows)), x @ theta[:-4]], axis=1)
            marginals, moves, _ = forward_backward(scores, theta[-4:].reshape(2, 2), at)
            w = weight[g[0]] / docs
            gradient[:-4] += w * ((label[rows] - marginals[:, 1]) @ x)
            seen = np.zeros((2, 2))
            seen[value, value] = len(rows) - len(g)
            gradient[-4:] += w * (seen - moves).ravel()
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return theta


def document_scores(theta: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' marginals of being good, of each document of a run.

    A line's score is the sum of its own part and its neighbours'; only these three numbers of a line are held, not its features.
    """
    starts, length, first = document_lines(data, offsets)
    weights = theta[: 3 * OWN].reshape(3, OWN).T
    parts = np.empty((3, len(starts)))
    for a, b, own in windows(data, starts, length):
        parts[:, a:b] = (own @ weights).T
    scores = parts[0]
    inner = np.ones(len(starts), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    scores[at] += parts[1, at - 1]
    scores[at - 1] += parts[2, at]
    weight = length + 1.0
    good = good_marginals(scores, theta[-4:].reshape(2, 2), first) * weight
    return np.clip(np.add.reduceat(good, first[:-1]) / np.add.reduceat(weight, first[:-1]), 0, 1)


def _fit_rows(stream):
    for batch in stream:
        for lo, data, offsets in runs(batch.column(1)):
            starts, length, first = document_lines(data, offsets)
            for i, (a, b) in enumerate(zip(first, first[1:])):
                if b - a <= FIT_LINES:  # others pass any bound alone
                    own = line_features(data[offsets[i] : offsets[i + 1]], starts[a:b] - offsets[i], length[a:b]).astype("<f4")
                    yield pa.RecordBatch.from_arrays(
                        [*(c[lo + i : lo + i + 1] for c in batch.columns[:1] + batch.columns[2:]), pa.array([b - a]), pa.array([own.tobytes()], pa.binary())],
                        ["rank", "label", "n", "lines"],
                    )


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = FIT_DOCUMENTS, lines_most: int = FIT_LINES) -> np.ndarray:
    """Weights fitted on at most ``most`` labelled documents, of ``lines_most`` lines together, for which ``may_learn``, a condition on the id column, holds.

    Of rows that share an id, the least label and the least text count.
    With labels of one kind only, or none, every weight is 0 and every score 0.5; so for empty tables.
    """
    known = pick(labels.filter(may_learn), doc_id=id_col, label=label_col).filter("doc_id is not null and label is not null")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    found = pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(chosen), "doc_id")
    texts = found.groupBy("doc_id").agg(F.first("label").cast("int").alias("label"), F.min("text").alias("text"))
    ranked = texts.select(F.struct(F.xxhash64("doc_id"), F.col("doc_id").cast("string")).cast("string").alias("rank"), "text", "label")
    schema = "rank string, label int, n long, lines binary"
    fitted = Scratch(docs.sparkSession).cut(ranked.mapInArrow(lean(_fit_rows), schema), "lines")
    so_far = F.sum("n").over(Window.orderBy("rank"))  # over numbers of at most ``most`` rows
    within = fitted.select("rank", so_far.alias("n")).filter(F.col("n") <= lines_most).select("rank")
    rows = fitted.join(F.broadcast(within), "rank").select("label", "lines").toArrow()
    good = rows.column("label").to_numpy() > 0
    lines = [np.frombuffer(x, "<f4").reshape(-1, OWN).astype(np.float64) for x in rows.column("lines").to_pylist()]
    if not len(good) or good.all() or not good.any():
        return np.zeros(3 * OWN + 4)
    order = sorted(range(len(lines)), key=lambda i: (good[i], lines[i].tobytes()))  # not the order in which tasks ended
    lines, good = [lines[i] for i in order], good[order]
    first = np.concatenate([[0], np.cumsum([len(x) for x in lines])])
    own = np.concatenate(lines)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return fit(np.concatenate([own, before, after], axis=1), first, good)


def score(docs: DataFrame, theta: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, and as column0, column1, ... the columns named in ``keep``: one narrow pass over whole texts.

    Null texts count as empty, one row comes out per row given, none for an empty table; null and repeated ids are carried. Columns
    of other names in ``docs`` play no part. A task holds some 80 bytes for each line of its longest text.
    """

    def batches(stream):
        for batch in stream:
            out = np.zeros(batch.num_rows)
            for lo, data, offsets in runs(batch.column(1)):
                out[lo : lo + len(offsets) - 1] = document_scores(theta, data, offsets)
            held = iter(batch.columns[2:])
            carried = [batch.column(0) if c == id_col else batch.column(1) if c == text_col else next(held) for c in keep]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), *carried], ["doc_id", "score", *(f"column{i}" for i in range(len(keep)))])

    others = {f"column{i}": c for i, c in enumerate(keep) if c not in (id_col, text_col)}
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"doc_id {kinds[id_col]}", "score double", *(f"column{i} {kinds[c]}" for i, c in enumerate(keep))])
    return pick(docs, doc_id=id_col, text=text_col, **others).mapInArrow(lean(batches), schema)
