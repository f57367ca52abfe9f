"""Exact top-k search by a bit-sliced index over quantised vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import Scratch, pick

#: Rows of one block of the index, and queries that meet a block in one task.
BLOCK_ROWS = 16384
QUERY_ROWS = 512
#: Components under PLAIN in size are usual; rows of a block of vectors with larger ones, whose slices are many.
PLAIN, WIDE_ROWS = 2.0**31, 1024
#: Stands for all scores from it on, and its negative for those down from that.
BEYOND = 2**63 - 1


def whole(values) -> np.ndarray:
    """Integral doubles as integers: 64-bit ones, or Python's where these are too short."""
    values = np.array(values, np.float64)
    return values.astype(np.int64) if not values.size or np.abs(values).max() < 2.0**62 else np.frompyfunc(int, 1, 1)(values)


def to_slices(values: np.ndarray) -> tuple[int, np.ndarray]:
    """(least value, slices) of an (n, dims) integer array.

    slices[j, b] is the bitmap, in words of 64 rows, of bit b of attribute j
    above the least value.
    """
    n, dims = values.shape
    low = int(values.min()) if values.size else 0
    bits = max(1, (int(values.max()) - low).bit_length()) if values.size else 1
    kind = object if values.dtype == object else np.uint64
    wide = np.zeros((-(-n // 64) * 64, dims), kind)
    wide[:n] = values - low if kind is object else values.astype(np.uint64) - np.uint64(low % 2**64)
    out = np.empty((dims, bits, len(wide) // 64), np.uint64)
    one = 1 if kind is object else np.uint64(1)
    for b in range(bits):
        bit = ((wide >> (b * one)) & one).astype(np.uint8)
        out[:, b] = np.packbits(np.ascontiguousarray(bit.T), axis=1, bitorder="little").view(np.uint64)
    return low, out


def add_slices(levels: dict[int, np.ndarray]) -> list[np.ndarray]:
    """Sum of bitmaps by significance, as one bitmap per significance: full adders on three slices at a time."""
    out, s = [], 0
    while levels:
        stack = levels.pop(s, None)
        if stack is None:
            out.append(None)
            s += 1
            continue
        carries = []
        while len(stack) > 1:
            m = len(stack) // 3
            if m:
                a, b, c = stack[:m], stack[m : 2 * m], stack[2 * m : 3 * m]
                half = a ^ b
                carries.append((a & b) | (half & c))
                stack = np.concatenate([half ^ c, stack[3 * m :]])
            else:
                carries.append((stack[0] & stack[1])[None])
                stack = (stack[0] ^ stack[1])[None]
        out.append(stack[0])
        if carries:
            levels[s + 1] = np.concatenate([*carries, levels[s + 1]]) if s + 1 in levels else np.concatenate(carries)
        s += 1
    return out


def scores(query: np.ndarray, low: int, slices: np.ndarray, mask: np.ndarray) -> tuple[int, list[np.ndarray]]:
    """(c, slices of v): the inner products are v + c. Negative weights take complemented slices."""
    dims, bits, words = slices.shape
    top = (1 << bits) - 1
    levels: dict[int, list[np.ndarray]] = {}
    for sign in (1, -1):
        weight = np.maximum(sign * query, 0)
        for a in range(int(weight.max()).bit_length() if len(weight) else 0):
            chosen = slices[np.flatnonzero(((weight >> a) & 1).astype(bool))]
            if sign < 0:
                chosen = ~chosen & mask
            for b in range(bits):
                levels.setdefault(a + b, []).append(chosen[:, b])
    total = add_slices({s: x for s, parts in levels.items() if len(x := np.concatenate(parts))})
    zero = np.zeros(words, np.uint64)
    constant = low * sum(query.tolist()) + top * sum(query[query < 0].tolist())
    return constant, [zero if x is None else x for x in total]


def top_rows(total: list[np.ndarray], allowed: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k greatest rows, from the most significant slice down; rows tied at the boundary go by position."""
    sure, tied = np.zeros_like(allowed), allowed.copy()
    for s in reversed(total):
        more = sure | (tied & s)
        n = int(np.bitwise_count(more).sum())
        if n <= k:
            sure, tied = more, tied & ~s
        else:
            tied = tied & s
    rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
    if len(rows) < k:
        rest = np.flatnonzero(np.unpackbits(tied.view(np.uint8), bitorder="little"))
        rows = np.concatenate([rows, rest[: k - len(rows)]])
    return rows


def value_at(total: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    kind = np.int64 if len(total) < 63 else object
    out = np.zeros(len(rows), kind)
    for s, bitmap in enumerate(total):
        out += ((bitmap[rows // 64] >> (rows % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64).astype(kind) << s
    return out


def _build(table: pa.Table) -> pa.Table:
    """The index of one block: rows by id, so that positions settle ties."""
    table = table.sort_by([("vec_id", "ascending"), ("rid", "ascending")])
    values = whole(table.column("q").to_pylist())
    low, slices = to_slices(values)
    as_bytes = lambda name: table.column(name).to_numpy().astype("<i8").tobytes()
    return pa.table(
        {
            "dims": pa.array([values.shape[1]], pa.int32()),
            "block": table.column("block")[:1],
            "low": pa.array([str(low)], pa.string()),
            "bits": pa.array([slices.shape[1]], pa.int32()),
            "ids": pa.array([as_bytes("vec_id")], pa.binary()),
            "rids": pa.array([as_bytes("rid")], pa.binary()),
            "slices": pa.array([slices.tobytes()], pa.binary()),
        }
    )


def _search(k: int):
    def search(index: pa.Table, queries: pa.Table) -> pa.Table:
        found = {"query_rid": [], "query_id": [], "vec_id": [], "score": []}
        for row in index.to_pylist():
            ids, rids = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["rids"], "<i8")
            slices = np.frombuffer(row["slices"], np.uint64).reshape(row["dims"], row["bits"], -(-len(ids) // 64))
            everyone = np.packbits(np.arange(slices.shape[2] * 64) < len(ids), bitorder="little").view(np.uint64)
            place = {r: i for i, r in enumerate(rids.tolist())}
            for rid, vec_id, q in zip(*(queries.column(c).to_pylist() for c in ("rid", "vec_id", "q"))):
                constant, total = scores(whole(q), int(row["low"]), slices, everyone)
                allowed = everyone.copy()
                if rid in place:
                    allowed[place[rid] // 64] &= ~np.uint64(1 << (place[rid] % 64))
                rows = top_rows(total, allowed, k)
                found["query_rid"].append(np.full(len(rows), rid))
                found["query_id"].append(np.full(len(rows), vec_id))
                found["vec_id"].append(ids[rows])
                exact = [v + constant for v in value_at(total, rows).tolist()]
                found["score"].append(np.array([min(max(v, -BEYOND), BEYOND) for v in exact], np.int64))
        return pa.table({c: pa.array(np.concatenate(x) if x else [], pa.int64()) for c, x in found.items()})

    return search


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    scale: float = 64.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row its k greatest inner products among all other rows.

    Components are quantised to floor(scale * x), x as double. Rows are dealt to
    blocks of about ``block_rows``; each block becomes bit slices. Queries, in
    groups of at most about ``query_rows``, meet every block: a task adds slices
    with bitmap arithmetic and keeps k rows, so memory is bounded and a
    frequent vector only makes ties, settled by smaller ids. The blocks' rows
    are merged by a ranking whose partial limit runs before the shuffle.

    ``is_query`` is a condition on the id column. Rows with a null id, and vectors
    null or holding a null or non-finite (also after scaling) component take no part; empty ones score 0 with each other. Vectors with components of
    over 31 bits have blocks of their own, with as many slices as they need; only a score of over 64
    bits among the results, which no long can hold, ends the job with an error. Vectors of different lengths are not compared.
    Of repeated ids each row counts; a row is never its own result. An empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession)
    scaled = lambda x: x.cast("double") * F.lit(scale)
    # floor() gives longs, which hold no more than 63 bits; from 2 ** 53 on every double is integral
    q = F.transform("v", lambda x: F.when(F.abs(scaled(x)) < 2.0**53, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    fits = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(scaled(x)) < F.lit(float("inf"))))
    rows = scratch.cut(
        vectors.select(vectors[f"`{id_col}`"].cast("long").alias("vec_id"), vectors[f"`{vector_col}`"].alias("v"), is_query.alias("asks"))
        .withColumn("rid", F.monotonically_increasing_id())
        .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fits)
        .select("rid", "vec_id", F.coalesce("asks", F.lit(False)).alias("asks"), F.size("v").alias("dims"), q.alias("q"), F.exists("v", lambda x: F.abs(scaled(x)) >= PLAIN).alias("wide")),
        "vectors",
    )
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asks"), F.count_if("wide").alias("wide")).first()
    plain, groups = max(1, round(n["n"] / block_rows)), max(1, round((n["asks"] or 0) / query_rows))
    wide = -(-n["wide"] // WIDE_ROWS)
    blocks = plain + wide
    block = F.when(F.col("wide"), plain + F.pmod(F.xxhash64("rid"), F.lit(max(1, wide)))).otherwise(F.pmod(F.xxhash64("rid"), F.lit(plain)))
    index = scratch.cut(
        rows.select("rid", "vec_id", "dims", "q", block.cast("int").alias("block"))
        .groupBy("dims", "block")
        .applyInArrow(_build, "dims int, block int, low string, bits int, ids binary, rids binary, slices binary"),
        "index",
    )
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asked = (
        rows.filter("asks")
        .select("rid", "vec_id", "dims", "q", F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(groups)).cast("int").alias("part"))
        .select("*", every(blocks).alias("block"))
    )
    keys = ["dims", "block", "part"]
    found = (
        index.select("*", every(groups).alias("part"))
        .groupBy(*keys)
        .cogroup(asked.groupBy(*keys))
        .applyInArrow(_search(k), "query_rid long, query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_rid").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    score = F.when(F.abs("score") < BEYOND, F.col("score")).otherwise(F.raise_error(F.lit("a score needs over 64 bits")))
    return best.select("query_id", "rank", "vec_id", score.alias("score"))
