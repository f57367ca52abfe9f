"""Hard negatives by a vector-approximation file: cells, score bounds by table lookup, exact scores for what may count."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import Scratch, pick

#: Rows of one block of the file, anchors that meet a block in one task, cells of a dimension.
BLOCK_ROWS, ANCHOR_ROWS, CELLS = 8192, 1024, 64
#: Anchors whose bounds are looked up at once, and rows at a time.
ANCHORS_AT_ONCE, ROWS_AT_ONCE = 16, 2048
#: Components under PLAIN in size are usual; rows of a block of vectors with larger ones, whose scores need integers of any length.
PLAIN, WIDE_ROWS = 2.0**14, 512
#: Stands for all scores from it on, and its negative for those down from that.
BEYOND = 2**63 - 1


def quantised(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, as integral doubles where they are small, else as Python's integers; scale is a power of two."""
    if not values.size or np.abs(values).max() < PLAIN:
        return np.floor(values * float(scale))
    small = np.abs(values) < 2.0**53 / scale
    out = np.empty(values.shape, object)
    out[small] = [int(x) for x in np.floor(values[small] * float(scale))]
    out[~small] = [(n * scale) // d for n, d in (float(x).as_integer_ratio() for x in values[~small])]
    return out


def approximated(values: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, low, high): the cell of each of (n, dims) values in its dimension, as (dims, n) bytes, and each cell's least and greatest value.

    Cells split a dimension's values of the block into equal counts; equal values share a cell.
    """
    n, dims = values.shape
    codes, low, high = np.zeros((dims, n), np.uint8), np.zeros((dims, cells)), np.zeros((dims, cells))
    for d in range(dims):
        x = np.sort(values[:, d])
        cuts = x[np.arange(1, cells) * n // cells]
        codes[d] = np.searchsorted(cuts, values[:, d], "right")
        cell = np.searchsorted(cuts, x, "right")
        first, end = np.searchsorted(cell, np.arange(cells), "left"), np.searchsorted(cell, np.arange(cells), "right")
        held = end > first
        low[d, held], high[d, held] = x[first[held]], x[end[held] - 1]
    return codes, low, high


def bounds(anchors: np.ndarray, codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most): (n, anchors) bounds of the inner products, summed over dimensions by looking up each row's cell in the anchors' tables."""
    dims, n = codes.shape
    m = len(anchors)
    kind = object if object in (anchors.dtype, low.dtype) else np.float64
    total = np.zeros((n, 2 * m), kind)
    tables = []
    for d in range(dims):
        a, b = np.multiply.outer(low[d], anchors[:, d]), np.multiply.outer(high[d], anchors[:, d])
        tables.append(np.concatenate([np.minimum(a, b), np.maximum(a, b)], axis=1))  # a row a cell: the bounds of all anchors
    for lo in range(0, n, ROWS_AT_ONCE):
        part = total[lo : lo + ROWS_AT_ONCE]
        for d in range(dims):
            part += tables[d].take(codes[d, lo : lo + ROWS_AT_ONCE], axis=0)
    return clipped(total[:, :m]), clipped(total[:, m:])


def kth_greatest(values: np.ndarray, k: int):
    """The k-th greatest value, or None if there are fewer."""
    if len(values) < k:
        return None
    return np.sort(values)[-k] if values.dtype == object else np.partition(values, len(values) - k)[len(values) - k]


class Block:
    """One block of the file, its rows in the order that settles ties."""

    def __init__(self, row: dict, scale: int):
        dims, n = row["dims"], row["n"]
        cells = len(row["low"]) // 8 // max(1, dims)
        read = lambda name, kind, *shape: np.frombuffer(row[name], kind).reshape(*shape)
        self.ids, self.rids, self.labels = row["ids"], read("rids", "<i8", n), read("labels", "<i8", n)
        self.codes, self.low, self.high = read("codes", np.uint8, dims, n), quantised(read("low", "<f8", dims, cells), scale), quantised(read("high", "<f8", dims, cells), scale)
        self.values = quantised(read("values", "<f8", n, dims), scale)
        kinds = {x.dtype == object for x in (self.low, self.high, self.values)}
        if len(kinds) > 1:
            self.low, self.high, self.values = (x if x.dtype == object else whole(x) for x in (self.low, self.high, self.values))

    def exact(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Inner products of these rows with the anchor, as integers."""
        found = self.values[rows].dot(anchor)
        return found.astype(np.int64) if found.dtype != object else clipped(found)


def whole(values: np.ndarray) -> np.ndarray:
    return np.frompyfunc(int, 1, 1)(values).astype(object) if values.size else values.astype(object)


def clipped(scores: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(scores, -BEYOND), BEYOND) if scores.dtype == object else scores


def first(scores: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest scores and their rows, ties by row; rows ascend."""
    order = np.argsort(-scores, kind="stable")[:k]
    return scores[order], rows[order]


def _best_of_label(block: Block, labels, own, least, most, anchors, k):
    """For each anchor the k best rows of its label in the block."""
    for j in range(len(anchors)):
        rows = np.flatnonzero((block.labels == labels[j]) & (block.rids != own[j]))
        bar = kth_greatest(least[rows, j], k)
        rows = rows if bar is None else rows[most[rows, j] >= bar]
        yield j, 0, *first(block.exact(rows, anchors[j]), rows, k)


def _in_windows(block: Block, labels, windows, least, most, anchors, k):
    """For each anchor and window (from, to) the k best rows of other labels whose score lies in it."""
    for j in range(len(anchors)):
        others, low, high = block.labels != labels[j], least[:, j], most[:, j]
        may = []
        for start, end in windows[j]:
            reach = others & (high >= start) & (low <= end)
            bar = kth_greatest(low[reach & (low >= start) & (high <= end)], k)
            may.append(np.flatnonzero(reach if bar is None else reach & (high >= bar)))
        rows = np.unique(np.concatenate(may)) if may else np.zeros(0, np.int64)
        scores = block.exact(rows, anchors[j])
        for place, (start, end) in enumerate(windows[j]):
            held = (scores >= start) & (scores <= end)
            yield j, place, *first(scores[held], rows[held], k)


def _build(cells: int):
    def build(table: pa.Table) -> pa.Table:
        """A block: rows by id, nulls last, so that positions settle ties."""
        table = table.sort_by([("known", "descending"), ("vec_id", "ascending"), ("rid", "ascending")])
        n, dims = len(table), table.column("dims")[0].as_py()
        values = np.array(table.column("v").to_pylist(), np.float64).reshape(n, dims)
        codes, low, high = approximated(values, cells)
        row = {
            "dims": dims, "block": table.column("block")[0].as_py(), "n": n, "ids": table.column("vec_id").to_pylist(),
            "rids": table.column("rid").to_numpy().astype("<i8").tobytes(), "labels": table.column("label").to_numpy().astype("<i8").tobytes(),
            "codes": codes.tobytes(), "low": low.tobytes(), "high": high.tobytes(), "values": np.ascontiguousarray(values).tobytes(),
        }
        return pa.Table.from_pylist([row], BLOCK)

    return build


BLOCK = pa.schema([("dims", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int64()))] + [(c, pa.binary()) for c in ("rids", "labels", "codes", "low", "high", "values")])
BLOCK_SQL = "dims int, block int, n int, ids array<long>, rids binary, labels binary, codes binary, low binary, high binary, values binary"
FOUND = pa.schema([("anchor_rid", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("rid", pa.int64()), ("score", pa.int64())])
FOUND_SQL = "anchor_rid long, place int, vec_id long, rid long, score long"


def _search(scale: int, k: int, low: int, high: int, windows: bool):
    def search(index: pa.Table, asked: pa.Table) -> pa.Table:
        found: dict[str, list] = {name: [] for name in FOUND.names}
        for row in index.to_pylist() if len(asked) else ():
            block = Block(row, scale)
            for lo in range(0, len(asked), ANCHORS_AT_ONCE):
                part = asked.slice(lo, ANCHORS_AT_ONCE).to_pydict()
                anchors = quantised(np.array(part["v"], np.float64).reshape(len(part["rid"]), row["dims"]), scale)
                if anchors.dtype == object or block.values.dtype == object:
                    anchors = whole(anchors)
                if anchors.dtype == object and block.values.dtype != object:
                    block.low, block.high, block.values = whole(block.low), whole(block.high), whole(block.values)
                least, most = bounds(anchors, block.codes, block.low, block.high)
                if windows:
                    # whole scores s with low * p <= 100 * s <= high * p
                    spans = [[(-(-low * p // 100), high * p // 100) for p in scores] for scores in part["scores"]]
                    hits = _in_windows(block, part["label"], spans, least, most, anchors, k)
                else:
                    hits = _best_of_label(block, part["label"], part["rid"], least, most, anchors, k)
                for j, place, scores, rows in hits:
                    found["anchor_rid"] += [part["rid"][j]] * len(rows)
                    found["place"] += [place] * len(rows)
                    found["vec_id"] += [block.ids[r] for r in rows]
                    found["rid"] += block.rids[rows].tolist()
                    found["score"] += [int(s) for s in scores]
        return pa.table(found, FOUND)

    return search


def hard_negatives(
    vectors: DataFrame,
    label: Column,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cells: int = CELLS,
    block_rows: int = BLOCK_ROWS,
    anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x), scale being a power of two; scores are integer inner products with the anchor, greater ones first and ties by
    smaller id. An anchor's positives are its ``positives`` best other rows of its label; for each of them come the ``negatives`` best rows
    of other labels with low * positive_score <= 100 * negative_score <= high * positive_score. ``label`` and ``is_anchor`` are conditions on the columns of ``vectors``.

    Rows are dealt to blocks of about ``block_rows`` by hash, so a frequent label or vector fills no block. A block is a
    vector-approximation file: a byte a component for its cell, and each cell's least and greatest value. Anchors, in groups of about
    ``anchor_rows``, meet every block: bounds of all scores come by table lookup, and a row is scored exactly
    only if its upper bound reaches the k-th lower bound among rows that surely count, for the positives first and then for each window. The blocks' few
    rows are merged by a ranking whose partial limit runs before the shuffle. The result is exact.

    Rows with a null label or vector, or a null or non-finite component, take no part; empty vectors do, with scores of 0. Vectors with components from 2**14 on have
    blocks of their own and integers of any length; only a score of over 64 bits next to a result, which no long can hold, ends the job with an
    error. Vectors of different lengths are not compared. A null id is no anchor unless ``is_anchor`` says so, and comes last among ties. Of
    repeated ids each row counts, as an anchor too; a row is never its own positive. An empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession)
    ids = pick(vectors.select(vectors[f"`{id_col}`"].cast("long").alias("vec_id"), vectors[f"`{vector_col}`"].cast("array<double>").alias("v"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks")), vec_id="vec_id", v="v", label="label", asks="asks")
    rows = scratch.cut(
        ids.withColumn("rid", F.monotonically_increasing_id())
        .filter(F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
        .select("rid", "vec_id", "label", "asks", F.size("v").alias("dims"), "v", F.exists("v", lambda x: F.abs(x) >= PLAIN).alias("wide")),
        "vectors",
    )
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asks"), F.count_if("wide").alias("wide")).first()
    plain, groups, wide = max(1, round(n["n"] / block_rows)), max(1, round(n["asks"] / anchor_rows)), -(-n["wide"] // WIDE_ROWS)
    dealt = lambda count, salt: F.pmod(F.xxhash64("rid", F.lit(salt)), F.lit(max(1, count)))
    block = F.when(F.col("wide"), plain + dealt(wide, 0)).otherwise(dealt(plain, 0)).cast("int")
    index = scratch.cut(
        rows.select("rid", "vec_id", F.col("vec_id").isNotNull().alias("known"), "label", "dims", "v", block.alias("block")).groupBy("dims", "block").applyInArrow(_build(cells), BLOCK_SQL), "index"
    )
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    keys = ["dims", "block", "part"]
    met = index.select("*", every(groups).alias("part")) if groups > 1 else index.withColumn("part", F.lit(0))

    def searched(asked: DataFrame, k: int, windows: bool) -> DataFrame:
        asked = asked.withColumn("part", dealt(groups, 1).cast("int")).withColumn("block", every(plain + wide))
        return met.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_search(scale, k, low, high, windows), FOUND_SQL)

    def ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    anchors = rows.filter("asks").select("rid", F.col("vec_id").alias("anchor_id"), "label", "dims", "v")
    best = scratch.cut(ranked(searched(anchors.drop("anchor_id"), positives, False), ["anchor_rid"], positives).select("anchor_rid", F.col("rank").alias("at"), "vec_id", "score"), "positives")
    scored = best.groupBy(F.col("anchor_rid").alias("rid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "score"))), lambda x: x["score"]).alias("scores"))
    hard = ranked(searched(anchors.drop("anchor_id").join(scored, "rid"), negatives, True), ["anchor_rid", "place"], negatives)
    told = best.select("anchor_rid", (F.col("at") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    fits = lambda c: F.when(F.abs(c) < BEYOND, F.col(c)).otherwise(F.raise_error(F.lit("a score needs over 64 bits"))).alias(c)
    named = hard.select("anchor_rid", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(told, ["anchor_rid", "place"])
    named = named.join(anchors.select(F.col("rid").alias("anchor_rid"), "anchor_id"), "anchor_rid")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", fits("positive_score"), fits("negative_score"))
