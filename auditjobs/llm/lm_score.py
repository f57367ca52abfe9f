"""Stupid-backoff scores of documents from n-gram counts over the whole corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import Scratch, numbered, pick, shuffle_parts
from ._memory import give_back, lean
from ._text import SEPARATORS, mix, runs, spans, word_hashes

ORDER = 3
#: Weight of each step back, and the count from which an n-gram of two or more words is in the model.
BACKOFF, LEAST_COUNT = 0.4, 2
#: Documents whose n-grams are combined before they are counted: 2 ** CHUNK_BITS rows of an input partition.
CHUNK_BITS = 10

U = np.uint64


def ngrams(column, order: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(row, hashes of its runs of 1, 2, ... order words) for each text; words as blanks and control separators part them, A-Z lower-cased."""
    for lo, data, offsets in runs(column):
        starts, ends, rows = spans(SEPARATORS[data], offsets)
        words = word_hashes(data, starts, ends)
        at = np.searchsorted(rows, np.arange(len(offsets)))
        for i in range(len(offsets) - 1):
            own = words[at[i] : at[i + 1]]
            out, h = [], np.zeros(len(own), np.uint64)
            for n in range(1, order + 1):
                h = mix(h[: len(own) - n + 1] * U(0x9E3779B97F4A7C15) + own[n - 1 :] + U(n)) if len(own) >= n else np.zeros(0, np.uint64)
                out.append(h)
            yield lo + i, out


class Piece:
    """Distinct n-grams of one length of a run of documents, with their counts there, by part of hash space."""

    def __init__(self, documents: list[np.ndarray], parts: int):
        every = np.concatenate(documents) if documents else np.zeros(0, np.uint64)
        found, self.inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
        part = (found % U(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
        self.by = np.argsort(part, kind="stable")
        self.grams, self.counts = found[self.by], counts[self.by].astype(np.int64)
        self.bounds = np.searchsorted(part[self.by], np.arange(parts + 1))
        self.ends = np.cumsum([len(d) for d in documents])[:-1]

    def totals(self) -> list[np.ndarray]:
        """The count of each n-gram of each document."""
        by_value = np.empty(len(self.counts))
        by_value[self.by] = self.counts
        return np.split(by_value[self.inverse], self.ends)


def _chunk_rows(lengths: tuple[int, ...], parts: int):
    def emit(stream):
        held, chunk, lo, hi = [], None, 0, 0

        def out():
            rows = []
            for n in lengths:
                piece = Piece([d[n] for d in held], parts)
                for p, (i, j) in enumerate(zip(piece.bounds, piece.bounds[1:])):
                    if j > i:
                        rows.append((p, chunk, lo, hi, n, piece.grams[i:j].tobytes(), piece.counts[i:j].astype("<i4").tobytes()))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["part", "chunk", "lo", "hi", "n", "grams", "counts"])

        for batch in stream:
            rids = batch.column(0).to_numpy()
            for row, found in ngrams(batch.column(1), max(lengths) + 1):
                rid = int(rids[row])
                if rid >> CHUNK_BITS != chunk or rid <= hi:
                    if held:
                        yield out()
                    held, chunk, lo = [], rid >> CHUNK_BITS, rid
                hi = rid
                held.append(found)
        if held:
            yield out()

    return emit


def _add_counts(stream):
    """Per part of hash space: for the n-grams of a piece that other pieces have too, their places in the piece's run and total
    counts. A row without places tells that there is the piece; a row of n = -1 has the words of the part."""
    rows, grams, counts = [], [], []
    for batch in stream:
        for part, chunk, lo, hi, n, g, c in zip(*(x.to_pylist() for x in batch.columns)):
            rows.append((part, chunk, lo, hi, n))
            grams.append(np.frombuffer(g, np.uint64))
            counts.append(np.frombuffer(c, "<i4"))
    if not rows:
        return
    sizes = [len(g) for g in grams]
    words = sum(int(c.sum(dtype=np.int64)) for r, c in zip(rows, counts) if r[4] == 0)
    key, own = np.concatenate(grams), np.concatenate(counts).astype(np.int64)
    del grams, counts
    key = mix(key + np.repeat(np.array([r[4] for r in rows], np.uint64), sizes))
    by = np.argsort(key, kind="stable")
    head = np.flatnonzero(np.diff(key[by].view(np.int64), prepend=key[by[:1]].view(np.int64) - 1))
    total = np.empty(len(key), np.int64)
    total[by] = np.repeat(np.add.reduceat(own[by], head), np.diff(np.append(head, len(key))))
    at = np.concatenate([[0], np.cumsum(sizes)]).tolist()

    def out(part, chunk, lo, hi, n, places, totals):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((chunk, lo, hi, part, n, places, totals), kinds)], ["chunk", "lo", "hi", "part", "n", "places", "totals"])

    yield out(rows[0][0], -1, 0, 0, -1, b"", np.array([words], "<i8").tobytes())
    for row, i, j in zip(rows, at, at[1:]):
        more = np.flatnonzero(total[i:j] > own[i:j])
        found = total[i:j][more]
        # four bytes a total wherever all of the row fit
        yield out(*row, more.astype("<i4").tobytes(), found.astype("<i8" if len(found) and found.max() >= 2**31 else "<i4").tobytes())


def document_score(totals: list[np.ndarray], words: int, backoff: float, least: int) -> float:
    """Sum of log scores: the longest n-gram in the model over its context, each step back weighted; at last the word's share."""
    size = len(totals[0])
    if not size:
        return 0.0
    score = np.log(totals[0] / words)
    # from short to long: where the longer n-gram counts, its ratio replaces the shorter one's score
    for n in range(1, len(totals)):
        if size <= n:
            break
        ratio = totals[n] / totals[n - 1][: size - n]
        score[n:] = np.where(totals[n] >= least, np.log(ratio), np.log(backoff) + score[n:])
    return float(score.sum())


def _score(order: int, parts: int, words: int, backoff: float, least: int):
    def score(texts: pa.Table, counts: pa.Table) -> pa.Table:
        texts = texts.sort_by("rid")
        rids = texts.column("rid").to_numpy()
        documents = [found for _, found in ngrams(texts.column("text"), order)]
        totals = [list(d) for d in documents]  # n-grams, then their counts in their place
        pieces: dict[tuple, list] = {}
        for n, lo, hi, part, places, found in zip(*(counts.column(c).to_pylist() for c in ("n", "lo", "hi", "part", "places", "totals"))):
            pieces.setdefault((n, lo, hi), []).append((part, np.frombuffer(places, "<i4"), found))
        for (n, lo, hi), rows in pieces.items():
            i, j = np.searchsorted(rids, [lo, hi + 1]).tolist()
            piece = Piece([d[n] for d in documents[i:j]], parts)
            for part, places, found in rows:
                if len(places):
                    piece.counts[piece.bounds[part] + places] = np.frombuffer(found, "<i4" if len(found) == 4 * len(places) else "<i8")
            for k, x in enumerate(piece.totals(), i):
                totals[k][n] = x
        scores = [document_score(t, words, backoff, least) for t in totals]
        n_words = [len(d[0]) for d in documents]
        del documents, totals, pieces
        give_back()
        return pa.table({"doc_id": texts.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "log_score": pa.array(scores, pa.float64())})

    return score


def stupid_backoff(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, least: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, log_score (natural log, summed over its words).

    S(w | context) = count(context w) / count(context) if count(context w) >= ``least``, else
    ``backoff`` * S(w | shorter context); for single words count(w) / words of the corpus. Counts cover all
    documents, the scored one included. A null, empty or blank text scores 0.0 with no words.
    Repeated rows count and are scored each.

    The n-grams of a chunk of documents are made distinct and dealt by hash, so the most frequent word is one
    row a chunk; the counts meet there, and those that a chunk does not know by itself are joined back to it by its
    number. Where a scan cuts a chunk, its pieces are counted apart and named by their rows, so no two scans need cut alike.
    Words and pairs are counted first, then each longer length by itself: only one length's n-grams
    are on disk at a time. N-grams are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    scratch, parts = Scratch(spark), shuffle_parts(spark)
    base = numbered(pick(docs, doc_id=id_col, text=text_col))
    counted = None
    for lengths in [tuple(range(min(order, 2))), *((n,) for n in range(2, order))]:
        rows = base.select("rid", "text").mapInArrow(lean(_chunk_rows(lengths, parts)), "part int, chunk long, lo long, hi long, n int, grams binary, counts binary")
        met = scratch.cut(rows.repartition(parts, "part").mapInArrow(lean(_add_counts), "chunk long, lo long, hi long, part int, n int, places binary, totals binary"), "counts")
        counted = met if counted is None else counted.unionByName(met)
    words = sum(np.frombuffer(r.totals, "<i8")[0].item() for r in counted.filter("n = -1").select("totals").collect())
    chunks = base.select("rid", "doc_id", "text", F.shiftright("rid", CHUNK_BITS).alias("chunk")).groupBy("chunk")
    schema = f"doc_id {dict(base.dtypes)['doc_id']}, n_words long, log_score double"
    return chunks.cogroup(counted.filter("n >= 0").groupBy("chunk")).applyInArrow(_score(order, parts, words, backoff, least), schema)
