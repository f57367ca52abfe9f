"""Benchmark decontamination by a prefix-filtered join on word shingles, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import Scratch, pick

#: What stands between words: a word is a run of digits, a-z and characters from U+0080 on, after A-Z became a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Whatever lower() may change besides A-Z; unassigned code points too, which it may know better than the pattern does.
OTHER_UPPER = r"[\p{javaUpperCase}\p{javaTitleCase}\p{Cn}&&[^A-Z]]"
#: Item shingles are broadcast only if they were counted and are at most so many, of so many bytes.
BROADCAST_SHINGLES, BROADCAST_BYTES = 500_000, 48 << 20
#: The name of the shingle without words, which stands at the end of every text.
END = -1


def words_of(text: Column) -> Column:
    """The words of a text; none of null. lower() is much faster than translate(), and used where it changes A-Z alone."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(text.rlike(OTHER_UPPER), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))
    return F.array_remove(F.split(low, BETWEEN), "")  # faster than extracting words


def _zipped(words: Column, k: int) -> Column:
    """A struct w0 ... of the k words from each place on; null beyond the end."""
    return F.arrays_zip(*(F.slice(words, i + 1, F.greatest(F.size(words), F.lit(1))).alias(f"w{i}") for i in range(k)))


def _filled(names: list[str]) -> list[Column]:
    return [F.coalesce(F.col(f"s.{w}"), F.lit("")).alias(w) for w in names]


def _checked(shingles: DataFrame, names: list[str]) -> DataFrame:
    held = shingles.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(reduce(Column.__add__, map(F.length, names))), F.lit(0)).alias("size")).first()
    return F.broadcast(shingles) if held["n"] <= BROADCAST_SHINGLES and held["size"] <= BROADCAST_BYTES else shingles


def windows_of(items: DataFrame, scratch: Scratch, window: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(windows, shingles, owners) of items (item, words).

    windows: wid, n, off, sid for each shingle of each different window of n words;
    shingles: sid, w0 ... of the different shingles; owners: wid, item.
    """
    names = [f"w{i}" for i in range(k)]
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    cut_out = items.filter(F.size("words") > 0).select("item", "words", F.explode(starts).alias("at")).select("item", F.slice("words", F.col("at") + 1, window).alias("w"))
    held = scratch.cut(cut_out.distinct(), "item-windows")
    named = scratch.cut(held.groupBy("w").agg(F.count(F.lit(1)).alias("items")).select("w", F.monotonically_increasing_id().alias("wid")), "windows")
    owners = scratch.cut(held.join(named, "w").select("wid", "item"), "owners")
    parts = named.select("wid", F.size("w").alias("n"), F.posexplode(_zipped(F.col("w"), k)).alias("off", "s")).filter((F.col("off") == 0) | (F.col("off") <= F.col("n") - k))
    parts = parts.select("wid", "n", "off", *_filled(names))
    shingles = scratch.cut(parts.groupBy(*names).agg(F.count(F.lit(1)).alias("windows")).select(F.monotonically_increasing_id().alias("sid"), *names), "shingles")
    windows = scratch.cut(parts.join(shingles, names).select("wid", "n", "off", "sid"), "window-shingles")
    return windows, shingles, owners


def shingle_places(docs: DataFrame, shingles: DataFrame, k: int) -> DataFrame:
    """rid, doc_id, n_words, pos, sid: every place of a document (doc_id, text) where an item's shingle stands, and one row with sid END a document.

    Words are made once and in place; the shingles of items are broadcast if they were counted and found
    few, so documents don't move. Beyond that the same join has two plain exchanges. Words are compared, not only hashes.
    """
    names = [f"w{i}" for i in range(k)]
    key = lambda own: F.xxhash64(*own).alias("key")
    short = [r[0] for r in shingles.select(reduce(Column.__add__, ((F.col(w) != "").cast("int") for w in names)).alias("n")).filter(F.col("n") < k).distinct().collect()]  # k - 1 numbers at most
    end = shingles.sparkSession.range(1).select(F.lit(END).cast("long").alias("sid"), *(F.lit("").alias(w) for w in names))
    known = _checked(shingles.select("sid", *names).unionByName(end), names).select(key(names), "sid", *(F.col(w).alias(f"own_{w}") for w in names))
    base = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", words_of(F.col("text")).alias("words"))
    # the place after the last word has a shingle without words, so that each document has a row
    base = base.select("rid", "doc_id", F.size("words").alias("n_words"), F.concat("words", F.array(F.lit(None).cast("string"))).alias("words"))
    rows = base.select("rid", "doc_id", "n_words", F.posexplode(_zipped(F.col("words"), k)).alias("pos", "s"))
    rows = rows.select("rid", "doc_id", "n_words", "pos", *_filled(names))
    if short:  # items of fewer words than a shingle: their only shingle is of that length
        of = lambda n: F.array(*(F.col(w) if i < n else F.lit("") for i, w in enumerate(names)))
        full = (F.col(names[-1]) != "") | (F.col(names[0]) == "")
        forms = F.array(F.when(full, of(k)), *(F.when(F.col(names[n - 1]) != "", of(n)) for n in sorted(short)))
        rows = rows.select("rid", "doc_id", "n_words", "pos", F.explode(forms).alias("f")).filter("f is not null")
        rows = rows.select("rid", "doc_id", "n_words", "pos", *(F.col("f")[i].alias(w) for i, w in enumerate(names)))
    joined = rows.withColumn("key", key(names)).join(known, "key")
    # equal words, said so that the join keeps its one long key
    equal = (F.startswith(F.col(w), F.col(f"own_{w}")) & F.startswith(F.col(f"own_{w}"), F.col(w)) for w in names)
    return joined.filter(reduce(Column.__and__, equal)).select("rid", "doc_id", "n_words", "pos", "sid")


def occurrences(places: DataFrame, windows: DataFrame, k: int) -> DataFrame:
    """rid, start, n, wid: each place at which a document holds a whole window.

    A window's shingles are ordered by how often they stand in the documents. As all of them must be
    there, the rarest is the necessary prefix: its places alone propose starts. A start must lie within the document, and the
    shingles that cover the window must stand at their places.
    """
    counts = places.filter(F.col("sid") != END).groupBy("sid").agg(F.count(F.lit(1)).alias("seen"))
    ranked = windows.join(counts, "sid", "left").groupBy("wid", "n").agg(
        F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "sid", "off")).alias("least"),
        F.array_agg(F.when((F.col("off") % k == 0) | (F.col("off") == F.col("n") - k), F.struct("off", "sid"))).alias("cover"),
    )
    prefix = ranked.filter("least.seen > 0").select("wid", "n", F.col("least.sid").alias("sid"), F.col("least.off").alias("off"), "cover")
    start = F.col("pos") - F.col("off")
    proposed = places.join(prefix, "sid").filter((start >= 0) & (start + F.col("n") <= F.col("n_words"))).select("rid", start.alias("start"), "n", "wid", "cover")
    asked = proposed.select("rid", "start", "n", "wid", F.size("cover").alias("needed"), F.explode("cover").alias("c"))
    asked = asked.select("rid", "start", "n", "wid", "needed", (F.col("start") + F.col("c.off")).alias("pos"), F.col("c.sid").alias("sid"))
    there = asked.join(places.select("rid", "pos", "sid"), ["rid", "pos", "sid"], "left_semi")
    return there.groupBy("rid", "start", "n", "wid", "needed").agg(F.count(F.lit(1)).alias("found")).filter("found = needed").select("rid", "start", "n", "wid")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = 10,
    shingle: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, spans, items, rid.

    A window is ``window`` consecutive words of an item, or all words of an item
    that has fewer. A word of a document within any place where a window stands is hit; spans are the
    maximal runs of hit words as (start, end) word numbers, n_hit their total, items the ids of the items whose windows
    stand in the document, as sorted strings. A shingle has ``shingle`` words, at most ``window``.

    Documents are read once and stay where they are: only places of item shingles are written and joined. No pair of a document
    and an item is formed unless a window of the item stands in the document. A very common shingle is never a prefix unless all of its window is as common.

    Null and empty texts, and those without words, have no words and no hits; an item without words has no windows. Rows of one item id
    are one item; a null item id reads as ''. Every document row counts by itself, also with a repeated or null id. No items: no
    hits; no documents: no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    wanted = pick(items, item=item_col, text=item_text_col).select(F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words"))
    windows, shingles, owners = windows_of(wanted, scratch, window, shingle)
    places = scratch.cut(shingle_places(pick(docs, doc_id=id_col, text=text_col), shingles, shingle), "places")
    held = scratch.cut(occurrences(places, windows, shingle), "occurrences")

    ends = held.groupBy("rid", "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    by = Window.partitionBy("rid").orderBy("start")
    ends = ends.withColumn("before", F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    runs = ends.withColumn("run", F.count_if(F.col("before").isNull() | (F.col("start") > F.col("before"))).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("rid", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = runs.groupBy("rid").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    named = held.select("rid", "wid").distinct().join(owners, "wid").select("rid", "item").distinct()
    named = named.groupBy("rid").agg(F.array_sort(F.collect_list("item")).alias("items"))
    ended = places.filter(F.col("sid") == END).select("rid", "doc_id", F.col("n_words").cast("long").alias("n_words"))
    return ended.join(spans, "rid", "left").join(named, "rid", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<start: int, end: int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        "rid",
    )
