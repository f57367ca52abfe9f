"""Best-fit packing of tokenised documents into sequences of fixed capacity."""

from __future__ import annotations

import bisect
import functools
import json
import os
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._io import Scratch, pick
from ._memory import lean

CAPACITY = 4096
#: Closes each document.
END_ID = 1
#: Words whose ids a Python worker remembers; beyond it the memory starts anew. Only speed depends on it.
WORDS_KEPT = 1_000_000


#: Marks that often close a word, and Latin letters that no normalisation changes.
_CLOSING = {".", ","}
_PLAIN = {chr(c) for c in range(97, 0x180) if chr(c).isalpha() and chr(c).lower() == chr(c)}


@functools.lru_cache(maxsize=2)
def _encoder(path: str):
    """(encoder, encoder of plain words, the pattern of the first split, whether an id ends a part, remembered words)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    encoder = Tokenizer.from_file(path)
    spec = json.loads(encoder.to_str())
    suffix = spec["model"].get("end_of_word_suffix") or ""
    ends = np.zeros(encoder.get_vocab_size(), bool)
    ends[[i for token, i in encoder.get_vocab().items() if suffix and token.endswith(suffix)]] = True
    pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
    plain = Tokenizer.from_file(path)  # for words of plain letters, which normalisation and splits leave as they are
    plain.normalizer = normalizers.Sequence([])
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return encoder, plain, pattern, ends, {}


def _encode_each(encoder, pattern, ends, words: list[str]) -> list[bytes]:
    """Ids of each word, from one call over all of them: the parts of a word are counted, and each part ends with one id that says so.

    Without a pattern each word is one part.
    """
    ids = np.array(encoder.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")  # without offsets
    counts = [len(pattern.findall(unicodedata.normalize("NFC", word).lower())) for word in words] if pattern else np.ones(len(words), int)
    parts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    stops = np.flatnonzero(ends[ids]) + 1
    if len(stops) != parts[-1]:  # this library's Unicode tables differ from the encoder's
        return [np.array(e.ids, "<u4").tobytes() for e in encoder.encode_batch_fast(words, add_special_tokens=False)]
    bounds = np.concatenate([[0], stops])[parts] * 4
    data, bounds = ids.tobytes(), bounds.tolist()
    return [data[i:j] for i, j in zip(bounds, bounds[1:])]


def encode_words(texts: list[str], path: str, words_kept: int = WORDS_KEPT) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers.

    For tokenizers that never join characters across blanks or line ends, such
    as the word BPE here: each run between them is encoded once and remembered.
    """
    encoder, plain, pattern, ends, known = _encoder(path)
    if len(known) > words_kept:
        known.clear()
    if not texts:
        return []
    # the encoder lower-cases by itself; done before, forms of a word meet in one entry (the skipped letters fold by context)
    folded = pa.array([(text if "Σ" in text or "İ" in text else text.lower()).replace("\n", " ") for text in texts], pa.large_string())
    split = pc.split_pattern(folded, " ")
    met = pc.dictionary_encode(split.flatten())
    words = met.dictionary.to_pylist()  # each word of these texts once
    new = [word for word in words if word not in known]
    closed = [word for word in new if word[-1:] in _CLOSING and word[-2:-1] in _PLAIN]
    if closed:  # a part ends between a letter and a mark, so the word and the mark are encoded apart
        taken = set(closed)
        new = list({word for word in new if word not in taken} | {word[:-1] for word in closed if word[:-1] not in known} | (_CLOSING - known.keys()))
    simple, rest = [], []
    for word in new:
        (simple if word and _PLAIN.issuperset(word) else rest).append(word)
    for some_words, by, split_at in ((simple, plain, None), (rest, encoder, pattern)):
        for at in range(0, len(some_words), 4096):
            some = some_words[at : at + 4096]
            known.update(zip(some, _encode_each(by, split_at, ends, some)))
    known.update([(word, known[word[:-1]] + known[word[-1]]) for word in closed])
    ids = [known[word] for word in words]
    out = _laid_out(ids, met.indices.to_numpy(), split.offsets.to_numpy())
    for word in [word for word in new if len(word) > 64] + [word for word in closed if len(word) > 64]:
        del known[word]
    return out


def _laid_out(ids: list[bytes], places: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The ids of each text, whose words offsets[i] to offsets[i + 1] have the ids at their places."""
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    first = np.cumsum(size) - size
    lengths = size[places]
    ends = np.cumsum(lengths)
    take = np.repeat(first[places] - (ends - lengths), lengths)
    take += np.arange(len(take))
    data = np.frombuffer(b"".join(ids), "<u4")[take].tobytes()
    at = (np.append(0, ends)[offsets] * 4).tolist()
    return [data[i:j] for i, j in zip(at, at[1:])]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", words_kept: int = WORDS_KEPT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the closing id, cut every ``capacity`` ids.

    A null or empty text has the closing id alone.
    """
    closing = np.array([end_id], "<u4").tobytes()

    def runs(texts, most=1 << 22):
        run, size = [], 0
        for i, text in texts:
            run.append((i, text))
            size += len(text)
            if size >= most:
                yield run
                run, size = [], 0
        yield run

    def batches(stream):
        for batch in stream:
            row, piece, start, length, crc = [], [], [], [], []
            for run in runs((i, t or "") for i, t in enumerate(batch.column(1).to_pylist())):
                for (i, _), ids in zip(run, encode_words([t for _, t in run], path, words_kept)):
                    ids += closing
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        row.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = dict(docs.dtypes)[id_col]
    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(lean(batches), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Supersteps of bulk best fit over sizes, largest first.

    In one superstep all pieces of a length meet all gaps. Sequences of equal
    gap form runs (first sequence, count). The sweep takes the successor gap,
    the smallest that is large enough, and fills its run; where more pieces
    want a run than it holds, the lower ranks win and the others go on to the
    next successor, at last to new sequences. Gaps are updated before the next
    length. Each step ends a run or a length and opens at most three runs, so
    their number depends on the capacity, not on the documents.

    Returns (length, first rank, end rank, first sequence, pieces a sequence, offset).
    """
    gaps: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}
    steps, opened = [], 0

    def put(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in runs:
                bisect.insort(gaps, gap)
                runs[gap] = []
            runs[gap].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            k = bisect.bisect_left(gaps, length)
            if k < len(gaps):
                gap = gaps[k]
                first, count = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[k]
            else:
                gap, first = capacity, opened
                count = -(-left // (capacity // length))
                opened += count
            each = gap // length
            full = min(count, left // each)
            if full:
                steps.append((length, rank, rank + full * each, first, each, capacity - gap))
                put(gap - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < count and left:  # fewer pieces than one sequence of the run can hold
                steps.append((length, rank, rank + left, first + full, left, capacity - gap))
                put(gap - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(gap, first + full, count - full)
    return steps


def pack(
    docs: DataFrame,
    path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_kept: int = WORDS_KEPT,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces are ranked within their length by counts per input partition, so no
    task sorts a whole length. The only thing sent to the driver is the
    histogram of lengths, at most ``capacity`` rows; the supersteps of
    :func:`best_fit` come back as a broadcast whose size depends on the capacity
    alone. Repeated rows are packed each on its own; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    cut = scratch.cut(pieces(docs, path, capacity, end_id, id_col, text_col, words_kept).withColumn("shard", F.spark_partition_id()), "pieces")
    counts = scratch.cut(cut.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n")), "counts")
    before = counts.select(
        "length",
        "shard",
        (F.sum("n").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"),
    )
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = docs.sparkSession.createDataFrame(
        best_fit(histogram, capacity),
        "length long, from_rank long, to_rank long, first_sequence long, each long, base long",
    )
    local = F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = cut.join(before, ["length", "shard"]).withColumn("rank", F.col("before") + local - 1)
    at = (ranked["length"] == steps["length"]) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    k = F.col("rank") - F.col("from_rank")
    return ranked.join(F.broadcast(steps), at).select(
        "doc_id",
        "piece",
        "start",
        ranked["length"],
        "ids_crc32",
        (F.col("first_sequence") + F.floor(k / F.col("each"))).alias("sequence_id"),
        (F.col("base") + (k % F.col("each")) * ranked["length"]).alias("offset"),
    )
