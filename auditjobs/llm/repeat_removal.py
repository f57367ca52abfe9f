"""Removal of repeated passages: every byte under a fixed-length string that also starts earlier."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import Scratch, broadcast_if_light, numbered, pick, shuffle_parts
from ._memory import lean
from ._text import hashes, mix, runs, sums

#: Bytes of a repeated string, and of the substrings whose least hash anchors it.
WINDOW, GRAM = 100, 40
#: Anchors, or single strings, that a task combines before it passes them on.
BUFFER_ANCHORS = 1 << 18
#: Different segments of one anchor that are ordered together; beyond it their strings are dealt out singly.
ANCHOR_SEGMENTS = 2000
#: Segments of one column-wise construction.
BATCH_SEGMENTS = 1024

U = np.uint64
_POSITION = 28  # bits of the position in a packed hash
#: String starts of a longer text that are looked at together; far below 2 ** _POSITION.
STARTS = 1 << 20


# ---- column-wise construction --------------------------------------------------------------------


def _least(table: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of an array over lo..hi, from its sparse table."""
    k = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    return np.minimum(table[k, lo], table[k, hi + 1 - (1 << k)])


def column_wise(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, suffix length, common prefix with the row above up to ``cap``) of all suffixes in sorted order.

    Round j inserts, for every string at once, the symbol j places from its end. The
    transform so far gives each new suffix its row by counting equal symbols above; its common prefix with
    the rows next to it is one more than the least between the rows it extends.
    The transform, the common prefixes and the row names are read and written in order once a round.
    """
    n = len(starts)
    kind = np.uint8 if not len(data) or data.max() < 255 else np.uint16
    symbols = data.astype(kind) + kind(1)
    bwt, common = np.zeros(n, kind), np.zeros(n, np.uint8)
    string, length = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
    row = np.arange(n)
    ends = starts + lengths
    alive = np.arange(n)
    total = n + int(lengths.sum())
    table = np.zeros((max(1, total.bit_length()), total), np.uint8)
    place = np.empty(total, np.int32)
    for j in range(1, int(lengths.max()) + 1 if n else 0):
        alive = alive[lengths[alive] >= j]
        at = row[alive]
        bwt[at] = symbols[ends[alive] - j]
        size = len(bwt)
        order = np.argsort(bwt, kind="stable")
        place[order] = np.arange(size, dtype=np.int32)
        finished = size - int(np.count_nonzero(bwt))
        k = place[at].astype(np.int64)
        new = n + k - finished
        table[0, :size] = common
        level, half = 1, 1
        while 2 * half <= size:
            np.minimum(table[level - 1, : size - 2 * half + 1], table[level - 1, half : size - half + 1], out=table[level, : size - 2 * half + 1])
            level, half = level + 1, 2 * half
        above, below = order[np.maximum(k - 1, 0)], order[np.minimum(k + 1, size - 1)]
        symbol = bwt[at]
        top, bottom = (k > 0) & (bwt[above] == symbol), (k + 1 < size) & (bwt[below] == symbol)
        before = np.where(top, np.minimum(_least(table, np.where(top, above + 1, 0), np.where(top, at, 0)), cap - 1) + 1, 0).astype(np.uint8)
        after = np.where(bottom, np.minimum(_least(table, np.where(bottom, at + 1, 0), np.where(bottom, below, 0)), cap - 1) + 1, 0).astype(np.uint8)
        old = np.ones(size + len(at), bool)
        old[new] = False
        grown = []
        for array in (bwt, common, string, length):
            wider = np.zeros(len(old), array.dtype)
            wider[old] = array
            grown.append(wider)
        bwt, common, string, length = grown
        string[new], length[new] = alive, j
        common[new] = before
        follows = new + 1 < len(common)
        common[new[follows] + 1] = after[follows]
        row[alive] = new
        # finished strings keep their sentinel; their rows are not needed again
    return string.astype(np.int64), length.astype(np.int64), common


def repeated_windows(segments: list[bytes], order: np.ndarray, window: int) -> list[np.ndarray]:
    """For each segment the offsets of its strings of ``window`` bytes that a string at a smaller (order, offset) equals.

    order: position of each segment's first byte in the whole collection; equal bytes of one document have
    increasing positions.
    """
    lengths = np.array([len(s) for s in segments], np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    string, size, common = column_wise(np.frombuffer(b"".join(segments), np.uint8), starts, lengths, window)
    group = np.cumsum(common < window)
    whole = size >= window
    string, offset, group = string[whole], (lengths[string] - size)[whole], group[whole]
    document, first = order[string, 0], order[string, 1] + offset
    by = np.lexsort((first, document, group))
    group, document, first = group[by], document[by], first[by]
    again = np.zeros(len(by), bool)
    # the earliest row of a group is kept, with any rows that stand for the very same bytes
    lead = np.flatnonzero(np.diff(group, prepend=-1))
    head = np.repeat(lead, np.diff(np.append(lead, len(by))))
    again = (document != document[head]) | (first != first[head])
    out = [[] for _ in segments]
    hit = by[again]
    where = np.argsort(string[hit], kind="stable")
    hit = hit[where]
    at = np.searchsorted(string[hit], np.arange(len(segments) + 1))
    return [np.sort(offset[hit[i:j]]) for i, j in zip(at, at[1:])]


# ---- anchors -------------------------------------------------------------------------------------


def anchored_segments(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, content hash, row, start, end) of the segments of a run; positions count from the run's start.

    Each string of ``window`` bytes has as anchor its substring of ``gram`` bytes with the least hash, the
    leftmost of equals; a segment spans the neighbouring strings with one anchor. Equal strings
    have equal anchors, so they are in segments with equal anchor hashes.
    """
    n, wide = len(data), window - gram + 1
    none = np.zeros(0, np.int64)
    if n < window:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    prefix = sums(data)
    at = np.arange(n - gram + 1)
    gram_hash = hashes(prefix, at, at + gram)
    least = (gram_hash >> U(_POSITION) << U(_POSITION)) | at.astype(np.uint64)
    span = 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: n - window + 1], least[wide - span :][: n - window + 1])
    room = np.repeat(offsets[1:], np.diff(offsets))[: len(least)] - np.arange(len(least))
    inside = np.flatnonzero(room >= window)
    anchor = (least[inside] & U((1 << _POSITION) - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(anchor, prepend=-1))
    last = np.append(first[1:], len(anchor)) - 1
    anchor = anchor[first]
    start, end = inside[first], inside[last] + window
    content = mix(hashes(prefix, start, end) + (anchor - start).astype(np.uint64))
    return gram_hash[anchor], content, np.searchsorted(offsets, start, "right") - 1, start, end


def merged(rid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching spans of a row made one."""
    if not len(rid):
        return rid, lo, hi
    by = np.lexsort((lo, rid))
    rid, lo, hi = rid[by], lo[by], hi[by]
    shift = (np.cumsum(np.diff(rid, prepend=rid[0]) != 0)) * (int(hi.max()) + 2)
    reach = np.maximum.accumulate(hi + shift)
    new = np.ones(len(rid), bool)
    new[1:] = (lo + shift)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(rid)) - 1
    return rid[first], lo[first], reach[last] - shift[last]


_BUNDLE = "part int, kinds binary, rids binary, los binary, his binary, anchors binary, packed array<binary>"
#: Kinds of spans: repeated, to compare within its anchor, to compare string by string.
REPEATED, CLOSE, SINGLE = 0, 1, 2
_NAMES = ["part", "kinds", "rids", "los", "his", "anchors", "packed"]


def _bundle(parts: int, kind: int, rid, lo, hi, anchor=None) -> pa.RecordBatch:
    """Spans in one row per part of the documents."""
    anchor = np.zeros(len(rid), np.int64) if anchor is None else anchor
    part = rid % parts
    by = np.argsort(part, kind="stable")
    at = np.searchsorted(part[by], np.arange(parts + 1))
    columns = [x[by].astype(t) for x, t in ((rid, "<i8"), (lo, "<i4"), (hi, "<i4"), (anchor, "<i8"))]
    rows = [(p, np.full(j - i, kind, np.uint8).tobytes(), *(x[i:j].tobytes() for x in columns)) for p, (i, j) in enumerate(zip(at, at[1:])) if j > i]
    arrays = [pa.array([r[k] for r in rows], pa.binary() if k else pa.int32()) for k in range(6)]
    return pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(rows), pa.list_(pa.binary()))], _NAMES)


_FOUND = np.dtype([("kind", "u1"), ("lo", "<i4"), ("hi", "<i4"), ("anchor", "<i8")])


def _by_document(repeated: bool):
    """Per part of the documents: rid and its spans in one binary; repeated spans merged."""

    def gather(stream):
        held = []
        for batch in stream:
            for row in zip(*(batch.column(c).to_pylist() for c in _NAMES[1:6])):
                held.append([np.frombuffer(x, t) for x, t in zip(row, ("u1", "<i8", "<i4", "<i4", "<i8"))])
        if not held:
            return
        kind, rid, lo, hi, anchor = (np.concatenate(x) for x in zip(*held))
        mine = (kind == REPEATED) == repeated
        kind, rid, lo, hi, anchor = (x[mine] for x in (kind, rid, lo, hi, anchor))
        if repeated:
            rid, lo, hi = merged(rid, lo.astype(np.int64), hi.astype(np.int64))
            kind, anchor = np.zeros(len(rid), np.uint8), np.zeros(len(rid), np.int64)
        by = np.argsort(rid, kind="stable")
        found = np.empty(len(rid), _FOUND)
        for name, x in (("kind", kind), ("lo", lo), ("hi", hi), ("anchor", anchor)):
            found[name] = x[by]
        rids, first = np.unique(rid[by], return_index=True)
        last = np.append(first[1:], len(rid))
        yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array([found[i:j].tobytes() for i, j in zip(first, last)], pa.binary())], ["rid", "found"])

    return gather


def _sorted_firsts(anchor, content, doc, rid, lo, hi):
    """Columns in the order of (anchor, content, doc, rid, lo), which rows are the first of a content, which start an anchor."""
    by = np.lexsort((lo, rid, doc, content, anchor))
    columns = [x[by] for x in (anchor, content, doc, rid, lo, hi)]
    heads = np.ones(len(by), bool)
    heads[1:] = columns[0][1:] != columns[0][:-1]
    firsts = heads.copy()
    firsts[1:] |= columns[1][1:] != columns[1][:-1]
    return columns, firsts, heads


def _anchor_rows(window: int, gram: int, parts: int):
    """Per task: spans that repeat an earlier equal segment of the task; the earliest of each content, packed by anchor."""

    def flush(held):
        columns, firsts, heads = _sorted_firsts(*(np.concatenate(x) for x in zip(*held)))
        yield _bundle(parts, REPEATED, *merged(*(columns[c][~firsts] for c in (3, 4, 5))))
        anchor, content, doc, rid, lo, hi = (x[firsts] for x in columns)
        group = np.cumsum(heads[firsts]) - 1
        many = np.bincount(group)[group] > ANCHOR_SEGMENTS if len(group) else np.zeros(0, bool)
        yield _bundle(parts, SINGLE, rid[many], lo[many], hi[many], anchor[many].view(np.int64))
        marks = np.unique(anchor[many])
        few = ~many
        none = np.full(len(marks), -1, np.int64)
        packed = [np.concatenate([x[few], y]) for x, y in zip((anchor, content, doc, rid, lo, hi), (marks, np.zeros(len(marks), np.uint64), none, none, none, none))]
        part = packed[0] % U(parts)
        by = np.argsort(part, kind="stable")
        at = np.searchsorted(part[by], np.arange(parts + 1, dtype=np.uint64))
        packed = [x[by] for x in packed]
        rows = [(p, [x[i:j].astype(x.dtype if k < 4 else np.int32).tobytes() for k, x in enumerate(packed)]) for p, (i, j) in enumerate(zip(at, at[1:])) if j > i]
        none = [pa.nulls(len(rows), pa.binary())] * 5
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *none, pa.array([r[1] for r in rows], pa.list_(pa.binary()))], _NAMES)

    def emit(stream):
        held, waiting = [], 0
        for batch in stream:
            rids = batch.column(0).to_numpy()
            docs = batch.column(1).to_numpy(zero_copy_only=False)
            for first, data, offsets in runs(batch.column(2)):
                # a text of many strings goes by pieces: each string is in one piece, and equal ones still have equal anchors
                for at in range(0, len(data), STARTS) if len(offsets) == 2 else (0,):
                    piece, ends = (data[at : at + STARTS + window - 1], np.array([0, min(STARTS + window - 1, len(data) - at)])) if len(offsets) == 2 else (data, offsets)
                    anchor, content, row, lo, hi = anchored_segments(piece, ends, window, gram)
                    held.append((anchor, content, docs[first + row], rids[first + row], at + lo - ends[row], at + hi - ends[row]))
                    waiting += len(anchor)
                    if waiting >= BUFFER_ANCHORS:
                        yield from flush(held)
                        held, waiting = [], 0
        if waiting:
            yield from flush(held)

    return emit


def _meet_anchors(parts: int):
    """Per part of anchor hashes: repeats of whole segments, and the segments that must be compared further."""

    def meet(stream):
        held = []
        for batch in stream:
            packed = batch.column(6)
            yield batch.filter(packed.is_null())
            for row in packed.to_pylist():
                if row is not None:
                    held.append([np.frombuffer(x, t) for x, t in zip(row, (np.uint64, np.uint64, np.int64, np.int64, np.int32, np.int32))])
        if not held:
            return
        columns, firsts, heads = _sorted_firsts(*(np.concatenate(x) for x in zip(*held)))
        columns[4], columns[5] = columns[4].astype(np.int64), columns[5].astype(np.int64)
        mark = columns[3] < 0
        again = ~firsts & ~mark
        yield _bundle(parts, REPEATED, *merged(*(columns[c][again] for c in (3, 4, 5))))
        group = np.cumsum(heads) - 1
        contents = np.bincount(group, weights=firsts & ~mark)[group]
        wide = (contents > ANCHOR_SEGMENTS) | (np.bincount(group, weights=mark)[group] > 0)
        first = firsts & ~mark
        for kind, chosen in ((SINGLE, first & wide), (CLOSE, first & ~wide & (contents > 1))):
            anchor, _, _, rid, lo, hi = (x[chosen] for x in columns)
            yield _bundle(parts, kind, rid, lo, hi, anchor.view(np.int64))

    return meet


def _few(stream, rows: int = 512):
    """The batches in slices of few rows, so that only these are Python objects at a time."""
    for batch in stream:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _cut_segments(window: int, parts: int):
    """Per document with segments to compare: their bytes by anchor, or their strings' hashes."""

    def row(part, kind, body, rest):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([body], pa.binary()), pa.array([rest.astype("<i8").tobytes()], pa.binary())], ["part", "kind", "body", "rest"])

    def cut(stream):
        close = {p: [] for p in range(parts)}
        single = []
        size = strings = 0

        def close_out():
            for p, rows in close.items():
                if rows:
                    yield row(p, CLOSE, b"".join(r[0] for r in rows), np.array([(len(r[0]), *r[1:]) for r in rows], np.int64))
                    rows.clear()

        def single_out():
            h, doc, rid, at = (np.concatenate(x) for x in zip(*single))
            part = h % U(parts)
            by = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[by], np.arange(parts + 1, dtype=np.uint64))
            rest = np.stack([doc, rid, at], axis=1)
            for p, (i, j) in enumerate(zip(bounds, bounds[1:])):
                if j > i:
                    yield row(p, SINGLE, h[by[i:j]].tobytes(), rest[by[i:j]])
            single.clear()

        for batch in _few(stream):
            for rid, doc, text, found in zip(*(batch.column(c).to_pylist() for c in ("rid", "doc_id", "body", "found"))):
                text = text or b""
                found = np.frombuffer(found, _FOUND)
                for _, lo, hi, anchor in found[found["kind"] == CLOSE].tolist():
                    close[anchor % 2**64 % parts].append((text[lo:hi], anchor, doc, rid, lo))
                    size += hi - lo
                for _, lo, hi, _ in found[found["kind"] == SINGLE].tolist():
                    # the strings' hashes do not depend on where the segment lies
                    at = np.arange(hi - lo - window + 1)
                    h = hashes(sums(np.frombuffer(text[lo:hi], np.uint8)), at, at + window)
                    single.append((h, np.full(len(at), doc), np.full(len(at), rid), lo + at))
                    strings += len(at)
                if size > 1 << 23:
                    yield from close_out()
                    size = 0
                if strings > BUFFER_ANCHORS:
                    yield from single_out()
                    strings = 0
        yield from close_out()
        if single:
            yield from single_out()

    return cut


def _compare_segments(window: int, parts: int):
    """Per part: the repeated strings among segments of one anchor, and among single strings."""

    def batches(anchor):
        """Bounds of runs of whole anchors of about BATCH_SEGMENTS segments."""
        edges = np.append(np.flatnonzero(np.diff(anchor, prepend=anchor[0] - 1 if len(anchor) else 0)), len(anchor))
        lo = 0
        while lo < len(anchor):
            k = int(np.searchsorted(edges, lo + BATCH_SEGMENTS, "right")) - 1
            hi = int(edges[k]) if edges[k] > lo else int(edges[k + 1])
            yield lo, hi
            lo = hi

    def compare(stream):
        bodies, rests, single = [], [], []
        for batch in stream:
            for kind, body, rest in zip(*(batch.column(c).to_pylist() for c in ("kind", "body", "rest"))):
                if kind == CLOSE:
                    rest = np.frombuffer(rest, np.int64).reshape(-1, 5)
                    cuts = np.concatenate([[0], np.cumsum(rest[:, 0])]).tolist()
                    bodies += [body[i:j] for i, j in zip(cuts, cuts[1:])]
                    rests.append(rest)
                else:
                    single.append((np.frombuffer(body, np.uint64), np.frombuffer(rest, np.int64).reshape(-1, 3)))
        if single:
            h = np.concatenate([x[0] for x in single])
            rest = np.concatenate([x[1] for x in single])
            by = np.lexsort((rest[:, 2], rest[:, 1], rest[:, 0], h))
            h, rest = h[by], rest[by]
            head = np.flatnonzero(np.diff(h.view(np.int64), prepend=h[:1].view(np.int64) - 1))
            head = np.repeat(head, np.diff(np.append(head, len(h))))
            again = (rest[:, 1] != rest[head, 1]) | (rest[:, 2] != rest[head, 2])
            yield _bundle(parts, REPEATED, *merged(rest[again, 1], rest[again, 2], rest[again, 2] + window))
        if not rests:
            return
        rest = np.concatenate(rests)
        by = np.argsort(rest[:, 1], kind="stable")
        rest = rest[by]
        document = np.unique(rest[:, [2, 3]], axis=0, return_inverse=True)[1].ravel()
        spans = []
        for lo, hi in batches(rest[:, 1]):
            order = np.stack([document[lo:hi], rest[lo:hi, 4]], axis=1)
            found = repeated_windows([bodies[i] for i in by[lo:hi]], order, window)
            n = [len(x) for x in found]
            at = np.concatenate(found) + np.repeat(rest[lo:hi, 4], n) if found else np.zeros(0, np.int64)
            spans.append(merged(np.repeat(rest[lo:hi, 3], n), at, at + window))
        yield _bundle(parts, REPEATED, *merged(*(np.concatenate(x) for x in zip(*spans))))

    return compare


def _without(texts: bool, kept_columns: int):
    def apply(stream):
        for batch in _few(stream):
            n, removed, spans, digests, kept = [], [], [], [], []
            for text, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                text = text or b""
                found = np.frombuffer(found or b"", _FOUND)
                lo, hi = found["lo"], found["hi"]
                at, parts = 0, []
                for i, j in zip(lo.tolist(), hi.tolist()):
                    parts.append(text[at:i])
                    at = j
                rest = b"".join([*parts, text[at:]])
                n.append(len(text))
                removed.append(len(text) - len(rest))
                spans.append(len(lo))
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode("utf-8", "ignore") if texts else None)
            columns = [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(digests, pa.string()), pa.array(kept, pa.string())]
            names = ["rid", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", *(f"column{i}" for i in range(kept_columns))]
            yield pa.RecordBatch.from_arrays(columns + batch.columns[4:], names)

    return apply


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", texts: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: rid, doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text (null unless ``texts``).

    column0, column1, ... follow: the input's columns named in ``keep``.

    Texts are UTF-8 bytes, a null text has none. A byte is removed if a string of ``window`` bytes over it
    also starts earlier: in a document with a smaller id, or in the same document before. Of rows with
    equal ids the one read first counts as earlier; a null id comes before all others. Strings are judged on the input.
    kept_text drops the bytes of characters that were cut in two.

    Equal strings share an anchor, a substring with the least hash, so only segments with an
    anchor hash that recurs are compared. A segment that equals an earlier one as a whole repeats it; the first segments
    of each content are ordered by the column-wise construction (:func:`column_wise`) over the
    segments of an anchor, whose common prefixes show the equal strings. Segments of anchors with more
    than ANCHOR_SEGMENTS contents are compared string by string, dealt by the strings' hashes, so
    no anchor is hot. Contents are told apart by 64-bit hashes until that construction, which reads bytes.
    """
    spark = docs.sparkSession
    scratch, parts = Scratch(spark), shuffle_parts(spark)
    carried = {f"column{i}": c for i, c in enumerate(keep)}
    base = numbered(pick(docs, doc_id=id_col, text=text_col, **carried)).select(
        "rid", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col("text").cast("binary").alias("body"), F.col("doc_id").alias("named"), *carried
    )
    rows = scratch.cut(
        base.select("rid", "doc_id", "body").mapInArrow(lean(_anchor_rows(window, gram, parts)), _BUNDLE).repartition(parts, "part").mapInArrow(lean(_meet_anchors(parts)), _BUNDLE),
        "segments",
    )
    dealt = lambda df: df.repartition(parts, "part")
    open_ = scratch.cut(dealt(rows).mapInArrow(lean(_by_document(False)), "rid long, found binary"), "open")
    compared = scratch.cut(
        base.select("rid", "doc_id", "body")
        .join(broadcast_if_light(open_, "found"), "rid")
        .mapInArrow(lean(_cut_segments(window, parts)), "part int, kind int, body binary, rest binary")
        .repartition(parts, "part")
        .mapInArrow(lean(_compare_segments(window, parts)), _BUNDLE),
        "compared",
    )
    spans = scratch.cut(dealt(rows.unionByName(compared)).mapInArrow(lean(_by_document(True)), "rid long, found binary"), "spans")
    scratch.keep_only(spans)
    joined = base.select("rid", "named", "body", *carried).join(broadcast_if_light(spans, "found"), "rid", "left").select("rid", F.col("named").alias("doc_id"), "body", "found", *carried)
    kinds = dict(joined.dtypes)
    schema = ", ".join([f"rid long, doc_id {kinds['doc_id']}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string", *(f"{c} {kinds[c]}" for c in carried)])
    return joined.mapInArrow(lean(_without(texts, len(keep))), schema)
