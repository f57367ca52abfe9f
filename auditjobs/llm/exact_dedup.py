"""Exact duplicates by deterministic block naming, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import Scratch, numbered, pick

#: Bytes of a block of the lowest level.
BLOCK_BYTES = 4096
#: Stands for the missing right half of a pair.
NOTHING = -(2**62)


def _named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys in sorted runs, each with its own integer."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    fingerprint: Callable[[Column], Column] = F.xxhash64,
    row_col: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, rid.

    rid numbers the rows; with ``row_col`` it is that column, a distinct long.

    Texts are cut into blocks of ``block_bytes`` bytes. Distinct blocks are
    sorted and named by integers; then adjacent names are paired and the
    distinct pairs named, level by level, until every document has one name.
    Equal names mean equal bytes: block contents are compared, never only
    their fingerprints, which just route names back to the blocks (blocks whose
    fingerprint is shared by other contents are routed by content).

    Grouping runs on map-side partial aggregates and the joins back have two
    plain exchanges, which AQE splits where one block or text is very frequent.

    A null text counts as empty; empty texts are equal to each other. Of equal
    texts the row with the largest id stays; among rows of the same id and text
    one stays. Null ids come before all others. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    body = F.coalesce(F.col("text").cast("binary"), F.lit(bytearray()))
    columns = {"doc_id": id_col, "text": text_col}
    base = pick(docs, **columns, rid=row_col) if row_col else numbered(pick(docs, **columns))
    base = base.select("doc_id", body.alias("body"), "rid")
    last = F.greatest(F.ceil(F.length("body") / F.lit(block_bytes)), F.lit(1)).cast("int") - 1
    blocks_of = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("body"), i * block_bytes + 1, F.lit(block_bytes)))

    rows = scratch.cut(
        base.select(
            "rid",
            "doc_id",
            F.sha2("body", 256).alias("text_sha256"),
            F.transform(blocks_of, lambda block: fingerprint(block)).alias("prints"),
        ),
        "documents",
    )
    blocks = base.select("rid", F.posexplode(blocks_of).alias("pos", "block")).withColumn("print", fingerprint(F.col("block")))
    # level 0: sorted distinct blocks get integers; contents are not kept
    names = scratch.cut(
        _named(blocks.groupBy("print", "block").agg(F.count(F.lit(1)).alias("n")), ["block"]).select("print", "name"), "blocks"
    )
    placed = rows.select("rid", F.posexplode("prints").alias("pos", "print"))
    shared = scratch.cut(names.groupBy("print").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("print"), "shared")
    if shared.isEmpty():
        level = placed.join(names, "print").select("rid", "pos", "name")
    else:
        clear = names.join(shared, "print", "left_anti")
        doubtful = blocks.join(shared, "print", "left_semi").select("rid", "pos", "block")
        by_content = scratch.cut(_named(doubtful.groupBy("block").agg(F.count(F.lit(1)).alias("n")), ["block"]).select("block", (-1 - F.col("name")).alias("name")), "contents")
        level = placed.join(clear, "print").select("rid", "pos", "name").unionByName(
            doubtful.join(by_content, "block").select("rid", "pos", "name")
        )
    level = scratch.cut(level, "level0")

    most = rows.agg(F.max(F.size("prints"))).first()[0] or 0
    height, done = 0, []
    sizes = rows.select("rid", F.size("prints").alias("blocks"))
    while True:
        width = 2**height  # blocks under one name of this level
        done.append(
            level.join(sizes.filter((F.col("blocks") <= width) & (F.col("blocks") > width // 2)), "rid").select(
                "rid", F.lit(height).alias("height"), "name"
            )
        )
        if most <= width:
            break
        open_ = level.join(sizes.filter(F.col("blocks") > width), "rid", "left_semi")
        pairs = scratch.cut(
            open_.groupBy("rid", F.shiftright("pos", 1).alias("pos")).agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(NOTHING)).alias("b"),
            ),
            "pairs",
        )
        named = scratch.cut(_named(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), ["a", "b"]).select("a", "b", "name"), "names")
        level = scratch.cut(pairs.join(named, ["a", "b"]).select("rid", "pos", "name"), "level")
        height += 1

    identity = done[0]
    for x in done[1:]:
        identity = identity.unionByName(x)
    named_rows = scratch.cut(
        rows.select("rid", "doc_id", "text_sha256").join(identity, "rid"), "identities"
    )
    groups = scratch.cut(
        named_rows.groupBy("height", "name").agg(F.max(F.struct("doc_id", "rid")).alias("keep"), F.count(F.lit(1)).alias("group_size")),
        "groups",
    )
    scratch.keep_only(named_rows, groups)
    return named_rows.join(groups, ["height", "name"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("keep.rid")).alias("kept"),
        "text_sha256",
        "rid",
    )
