"""Similarity join of documents on word shingles: exact Jaccard links and their components."""

from __future__ import annotations

import bisect
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._graph import components, joined
from ._io import Scratch, broadcast_if_small, numbered, pick, shuffle_parts
from ._memory import lean
from ._text import SEPARATORS, mix, runs, shingles, spans, word_hashes

#: Cells of the shingle frequency sketch, and cells of one row of it.
CELLS, CHUNK = 1 << 22, 1 << 16
#: A shingle is frequent if its cell counts this many times the mean cell, and this many besides.
FREQUENT_TIMES, FREQUENT_LEAST = 2, 12
#: Candidate groups of up to this many sets are verified in one piece; others by pivots and tiles.
GROUP_SETS = 256
#: Sets per pivot round, rounds, and sets and hashes of one side of a tile.
PIVOTS, PIVOT_ROUNDS, TILE_SETS, TILE_TOKENS = 4, 2, 1024, 1 << 19
#: Entries of short lists that are merged on a heap; more are merged as sorted runs.
HEAP_ENTRIES = 64
#: Keys that a task combines before it passes them on.
BUFFER_KEYS = 1 << 19

U = np.uint64


def shingle_sets(column, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text; none for a text without words.

    Words are maximal runs without blanks and control separators, A-Z lower-cased. Shingles are
    told apart by 64-bit hashes.
    """
    for lo, data, offsets in runs(column):
        starts, ends, rows = spans(SEPARATORS[data], offsets)
        words = word_hashes(data, starts, ends)
        at = np.searchsorted(rows, np.arange(len(offsets)))
        for i in range(len(offsets) - 1):
            yield lo + i, np.unique(shingles(words[at[i] : at[i + 1]], n))


def set_id(tokens: np.ndarray) -> int:
    """One number for equal sets."""
    return xxhash.xxh64_intdigest(tokens.tobytes()) - 2**63


def needed(size_a, size_b, num: int, den: int):
    """Least overlap of two linked sets: intersection / union >= num / den."""
    return -(-num * (size_a + size_b) // (num + den))


# ---- frequent shingles -------------------------------------------------------------------------


def frequent_cells(texts: DataFrame, n: int, total: int) -> np.ndarray:
    """Bitmap over cells of shingle hashes: which count far more than the mean cell, over all texts, whose sets have ``total`` shingles.

    It only decides which lists the search treats as long, never a result. Its size is fixed. Counts are summed and
    judged in one pass, so that only flags leave the tasks and no table of counts is written.
    """
    least = FREQUENT_TIMES * total / CELLS + FREQUENT_LEAST

    def count(stream):
        cells, held, waiting = np.zeros(CELLS, np.uint32), [], 0

        def add_held():
            if held:
                np.add.at(cells, (np.concatenate(held) >> U(42)).astype(np.int64), 1)
            held.clear()

        for batch in stream:
            for _, tokens in shingle_sets(batch.column(0), n):
                held.append(tokens)
                waiting += len(tokens)
                if waiting > 1 << 18:
                    add_held()
                    waiting = 0
        add_held()
        for i in range(0, CELLS, CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([i // CHUNK], pa.int32()), pa.array([cells[i : i + CHUNK].astype("<u4").tobytes()], pa.binary())], ["chunk", "counts"])

    def flag(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, chunk = np.zeros(CHUNK, np.int64), None
        for batch in groups:
            chunk = batch.column(0)[0].as_py()
            for counts in batch.column(1):
                counted += np.frombuffer(counts.as_buffer(), "<u4")
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.packbits(counted >= least).tobytes()], pa.binary())], ["chunk", "flags"])

    bitmap = np.zeros((CELLS // CHUNK, CHUNK // 8), np.uint8)
    flagged = texts.mapInArrow(lean(count), "chunk int, counts binary").groupBy("chunk").applyInArrow(flag, "chunk int, flags binary")
    for row in flagged.collect():  # CELLS / 8 bytes in all
        bitmap[row["chunk"]] = np.frombuffer(row["flags"], np.uint8)
    return bitmap.ravel()


def is_frequent(tokens: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    cell = (tokens >> U(42)).astype(np.int64)
    return (bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1


# ---- candidate keys ----------------------------------------------------------------------------


def _differ(size: int, num: int, den: int) -> int:
    """Most hashes in which linked sets of at most this size differ."""
    return 2 * size * (den - num) // (den + num)


def _ranges() -> list[int]:
    """Numbers of ranges at the levels, each about a quarter more than the last."""
    out = [5]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 5 // 4))
    return out


RANGES = _ranges()
#: All choices of three ranges of five.
THREE_OF_FIVE = np.array(list(itertools.combinations(range(5), 3)))


def levels(size: int, num: int, den: int) -> range:
    """The partition levels at which a set of this size may meet a linked set that is no smaller, or itself.

    A level has a tenth more ranges than two linked sets may differ in, and four, so that they share ranges that are not empty.
    """
    at = lambda m: bisect.bisect_left(RANGES, _differ(m, num, den) * 11 // 10 + 4)
    return range(at(size), at(size * den // num) + 1)


def keys(tokens: np.ndarray, size: int, num: int, den: int, salt: int) -> np.ndarray:
    """Keys of which two linked sets share one at least.

    The sets of two linked documents differ in at most d hashes. Hash space is cut
    into more than d + 1 ranges, so some range holds the same hashes of both; each key stands for one
    range and what the set has there. Empty ranges give keys only where a set has so many that a
    shared range might be empty. ``tokens`` may be any part of the set chosen by the hash
    alone, since the parts differ no more than the sets. Sets so small that they link only to equal ones have no keys.
    """
    most = size * (den - num) // num
    if not most and not _differ(size, num, den):
        return np.zeros(0, np.uint64)
    out = []
    for level in levels(size, num, den):
        count = RANGES[level]
        differ = min(count - 4, most)
        part = ((tokens >> U(32)) * U(count) >> U(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else np.zeros(0, np.int64)
        body = np.add.reduceat(mix(tokens ^ U(0xA5A5A5A55A5A5A5A)), first) if len(first) else np.zeros(0, np.uint64)
        tag = U((salt * 256 + level) * 0x9E3779B97F4A7C15 % 2**64)
        out.append(mix(body ^ mix(part[first].astype(np.uint64) + tag)))
        if count - len(first) > count - differ - 1:
            empty = np.setdiff1d(np.arange(count), part[first])
            out.append(mix(mix(empty.astype(np.uint64) + tag) + U(1)))
    return np.concatenate(out)


def document_keys(tokens: np.ndarray, bitmap: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys on the rare shingles where they are seven tenths of the set, and on all shingles where they may be fewer in a linked set."""
    n = len(tokens)
    rare = tokens[~is_frequent(tokens, bitmap)]
    out = []
    if 10 * len(rare) >= 7 * n:
        out.append(keys(rare, n, num, den, 1))
    # a linked set of m hashes with fewer than 0.7 m rare ones leaves this one at most 0.7 n den / num of them
    if 10 * num * len(rare) < 7 * n * den + 10 * num:
        out.append(keys(tokens, n, num, den, 2))
    return np.concatenate([np.zeros(0, np.uint64), *out])


def _combine(key: np.ndarray, sid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, their least set, edge ends, edge ends): each other set of a key gets an edge to the least."""
    order = np.lexsort((sid, key))
    key, sid = key[order], sid[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    hub = sid[np.flatnonzero(new)][np.cumsum(new) - 1]
    other = sid != hub
    edges = np.unique(np.stack([sid[other], hub[other]], axis=1), axis=0)
    return key[new], sid[new], edges[:, 0], edges[:, 1]


def _leads(sid: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sets that stand for these in the stars (a, b), whose a ascend."""
    if not len(a):
        return sid
    at = np.minimum(np.searchsorted(a, sid), len(a) - 1)
    return np.where(a[at] == sid, b[at], sid)


def keyed_edges(rows: DataFrame, keyed) -> DataFrame:
    """a, b: edges that connect all sets connected by shared keys; equal sets are one node.

    keyed: from a record batch to (set id, its keys), again and again. Keys travel in packed runs. Every task sends a
    key once, whatever the number of its documents that have it, so no key is hot. Sets that a task has connected stand
    as one for their keys, and are one star among its edges, so that edges grow with the sets, not with the keys they share.
    """
    parts = shuffle_parts(rows.sparkSession)

    def packed(key, sid, a, b):
        a, b = joined(a, b)
        sid = _leads(sid, a, b)
        order = np.argsort(key % U(parts), kind="stable")
        at = np.searchsorted((key % U(parts))[order], np.arange(parts + 1, dtype=np.uint64))
        rows = [(p, False, key[order[i:j]].tobytes(), sid[order[i:j]].tobytes()) for p, (i, j) in enumerate(zip(at, at[1:])) if j > i]
        for i in range(0, len(a), 1 << 15):
            rows.append((int(a[i] % parts), True, a[i : i + (1 << 15)].tobytes(), b[i : i + (1 << 15)].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.binary(), pa.binary()))], ["part", "edges", "x", "y"])

    def emit(stream):
        key, sid, waiting = [], [], 0
        for batch in stream:
            for own, k in keyed(batch):
                key.append(k)
                sid.append(np.full(len(k), own, np.int64))
                waiting += len(k)
                if waiting > BUFFER_KEYS:
                    yield packed(*_combine(np.concatenate(key), np.concatenate(sid)))
                    key, sid, waiting = [], [], 0
        if waiting:
            yield packed(*_combine(np.concatenate(key), np.concatenate(sid)))

    def meet(stream):
        key, sid, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], []
        for batch in stream:
            for _, edges, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                if edges:
                    held.append((np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)))
                else:
                    key.append(np.frombuffer(x, np.uint64))
                    sid.append(np.frombuffer(y, np.int64))
        held.append(_combine(np.concatenate(key), np.concatenate(sid))[2:])
        a, b = joined(*(np.concatenate(x) for x in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows.mapInArrow(lean(emit), "part int, edges boolean, x binary, y binary").repartitionById(parts, "part").mapInArrow(lean(meet), "a long, b long")


def candidate_edges(texts: DataFrame, n: int, num: int, den: int, bitmap: np.ndarray) -> DataFrame:
    """Edges between the sets of texts that share one of :func:`document_keys`."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def keyed(batch):
        for _, tokens in shingle_sets(batch.column(0), n):
            if len(tokens):
                yield set_id(tokens), document_keys(tokens, shared.value, num, den)

    return keyed_edges(texts, keyed)


def strict_keys(tokens: np.ndarray, size: int, num: int, den: int) -> np.ndarray:
    """Keys of which two linked sets share one at least, each over more of the set than those of :func:`keys`.

    Hash space is cut into parts of which one holds at most two of the differing hashes, and each part into five ranges,
    of which three are then alike in both sets; each key stands for three ranges of a part.
    """
    most = size * (den - num) // num
    if not most and not _differ(size, num, den):
        return np.zeros(0, np.uint64)
    out = []
    for level in levels(size, num, den):
        differ = -(-(RANGES[level] - 3) * 10 // 11) - 1  # the most in which sets of the level may differ
        parts = differ // 3 + 1
        place = ((tokens >> U(32)) * U(5 * parts) >> U(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        body = np.zeros(5 * parts, np.uint64)
        body[place[first]] = np.add.reduceat(mix(tokens ^ U(0x5A5A5A5AA5A5A5A5)), first)
        tag = U((level + 1000) * 0x9E3779B97F4A7C15 % 2**64)
        body = mix(body ^ mix(np.arange(5 * parts, dtype=np.uint64) + tag)).reshape(parts, 5)
        out.append(mix(body[:, THREE_OF_FIVE].sum(axis=2, dtype=np.uint64)).ravel())
    return np.concatenate(out)


def tokens_edges(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Edges between the sets (sid, tokens) that share one of :func:`strict_keys`."""

    def keyed(batch):
        for sid, tokens in zip(batch.column(0).to_pylist(), batch.column(1)):
            tokens = np.frombuffer(tokens.as_buffer(), np.uint64)
            yield sid, strict_keys(tokens, len(tokens), num, den)

    return keyed_edges(rows.select("sid", "tokens"), keyed)


# ---- how much of a set others have -------------------------------------------------------------


def able(rows: DataFrame, num: int, den: int) -> DataFrame:
    """sid, component, n, least, most: the sets (sid, component, tokens) that can still have a link, and the sizes of their partners.

    A hash that no other set of the group has lowers the overlap that any link of its set can reach, so it lowers the
    size of the partners; where that falls under the least size, the set has no link. Hashes are counted over the whole group.
    """
    parts = shuffle_parts(rows.sparkSession)

    def emit(stream):
        key, sid, waiting = [], [], 0

        def out():
            k, owner = np.concatenate(key), np.concatenate(sid)
            by = np.argsort(k, kind="stable")
            k, owner = k[by], owner[by]
            first = np.flatnonzero(np.diff(k.view(np.int64), prepend=~k[:1].view(np.int64)))
            owner[first[np.diff(np.append(first, len(k))) > 1]] = 0  # 0: more than one set has it
            k, owner = k[first], owner[first]
            part = k % U(parts)
            by = np.argsort(part, kind="stable")
            at = np.searchsorted(part[by], np.arange(parts + 1, dtype=np.uint64))
            found = [(p, k[by[i:j]].tobytes(), owner[by[i:j]].tobytes()) for p, (i, j) in enumerate(zip(at, at[1:])) if j > i]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.binary(), pa.binary()))], ["part", "keys", "sids"])

        for batch in stream:
            for own, group, tokens in zip(*(batch.column(c).to_pylist() for c in ("sid", "component", "tokens"))):
                own = own or 1  # one set in 2**64 may bear the number 0; with 1 in its place only its count is lost
                key.append(mix(np.frombuffer(tokens, np.uint64) ^ mix(np.array([group], np.int64).view(np.uint64))))
                sid.append(np.full(len(key[-1]), own, np.int64))
                waiting += len(key[-1])
                if waiting > BUFFER_KEYS:
                    yield out()
                    key, sid, waiting = [], [], 0
        if waiting:
            yield out()

    def meet(stream):
        key, sid = [], []
        for batch in stream:
            key += [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            sid += [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
        if key:
            key, sid = np.concatenate(key), np.concatenate(sid)
            by = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[by].view(np.int64), prepend=~key[by[:1]].view(np.int64)))
            lone = sid[by[first[np.diff(np.append(first, len(key))) == 1]]]
            sids, counts = np.unique(lone[lone != 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(sids), pa.array(counts.astype(np.int64))], ["sid", "alone"])

    alone = rows.select("sid", "component", "tokens").mapInArrow(lean(emit), "part int, keys binary, sids binary").repartitionById(parts, "part").mapInArrow(lean(meet), "sid long, alone long")
    alone = alone.groupBy("sid").agg(F.sum("alone").alias("alone"))
    sized = rows.select("sid", "component", (F.length("tokens") / 8).cast("long").alias("n")).join(alone, "sid", "left")
    shared = F.col("n") - F.coalesce("alone", F.lit(0))
    most = F.least(F.floor(F.lit(num + den) * shared / F.lit(num)) - F.col("n"), F.floor(F.lit(den) * F.col("n") / F.lit(num)))
    return sized.select("sid", "component", "n", F.ceil(F.lit(num) * F.col("n") / F.lit(den)).alias("least"), most.alias("most")).filter("least <= most")


# ---- T-occurrence search -----------------------------------------------------------------------


class Index:
    """Inverted lists over a few sets, searched by DivideSkip."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.owners = owner[order]
        self.vocabulary, self.first = np.unique(tokens[order], return_index=True)
        self.last = np.append(self.first[1:], len(tokens))

    def search(self, query: np.ndarray, num: int, den: int, labels: np.ndarray, own: int) -> list[int]:
        """Sets whose overlap with the query reaches what a link needs: one at least of each label that has any, none of label ``own``.

        T is the least overlap of any link. The T - 1 longest lists of the query
        are set aside; a set must be on one of the rest, the short lists, which are merged: on a
        heap, or as sorted runs where they hold much. A set found there is then looked up in the long lists by binary
        search; those that cannot reach what they need go on the way.
        """
        n = len(query)
        if not n or not len(self.vocabulary):
            return []
        at = np.searchsorted(self.vocabulary, query)
        at[at == len(self.vocabulary)] = 0
        lengths = np.where(self.vocabulary[at] == query, self.last[at] - self.first[at], 0)
        least = -(-num * n // den)
        order = np.argsort(lengths, kind="stable")
        short = order[: n - (least - 1)]
        short = short[lengths[short] > 0]
        if not len(short):
            return []
        long = order[n - (least - 1) :]
        lists = [self.owners[self.first[i] : self.last[i]] for i in at[short]]
        if lengths[short].sum() <= HEAP_ENTRIES:
            merged = np.fromiter(heapq.merge(*(x.tolist() for x in lists)), np.int64)
        else:
            merged = np.sort(np.concatenate(lists), kind="stable")
        start = np.flatnonzero(np.diff(merged, prepend=-1))
        found, count = merged[start], np.diff(np.append(start, len(merged)))
        m = self.sizes[found]
        want = -(-num * (n + m) // (num + den))
        fit = (labels[found] != own) & (den * np.minimum(n, m) >= num * np.maximum(n, m)) & (count + len(long) >= want)
        found, want = found[fit], want[fit] - count[fit]
        if not len(found):
            return []
        hits: list[int] = []
        label = labels[found]
        take = 1  # sets of each label that are looked up at once, more with each turn
        while len(found):
            by = np.argsort(label, kind="stable")
            head = np.flatnonzero(np.diff(label[by], prepend=label[by[0]] - 1))
            place = np.arange(len(by)) - np.repeat(head, np.diff(np.append(head, len(by))))
            now = by[place < take]
            reached = found[now][self._reach(found[now], want[now], query, at, lengths, long)]
            hits += reached.tolist()
            left = np.ones(len(found), bool)
            left[now] = False
            left &= ~np.isin(label, labels[reached])
            found, want, label = found[left], want[left], label[left]
            take *= 4
        return hits

    def _reach(self, owners: np.ndarray, want: np.ndarray, query, at, lengths, long) -> np.ndarray:
        """Which sets are on as many of the long lists as they want."""
        if len(owners) <= 16:
            asked = np.sort(query[long])
            out = []
            for owner, w in zip(owners.tolist(), want.tolist()):
                other = self.sets[owner]
                out.append(int((other[np.minimum(np.searchsorted(other, asked), len(other) - 1)] == asked).sum()) >= w)
            return np.array(out, bool)
        alive, missing = np.arange(len(owners)), want.copy()
        for k, i in enumerate(long.tolist()):
            if lengths[i]:
                on = self.owners[self.first[at[i]] : self.last[at[i]]]
                x = owners[alive]
                missing[alive] -= on[np.minimum(np.searchsorted(on, x), len(on) - 1)] == x
            alive = alive[missing[alive] <= len(long) - k - 1]
            if not len(alive):
                break
        return missing <= 0


def links_within(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect every class of linked sets; pairs already connected are not looked at."""
    return links_between(sets, sets, np.tile(np.arange(len(sets)), 2), num, den, same=True)


def links_between(queries: list[np.ndarray], sets: list[np.ndarray], labels: np.ndarray, num: int, den: int, same: bool = False) -> list[tuple[int, int]]:
    """The same from each query to the sets. labels: known classes of the queries, then of the sets. same: both are one list."""
    index, label, found = Index(sets), np.unique(labels, return_inverse=True)[1], []
    for i, query in enumerate(queries):
        for j in index.search(query, num, den, label[len(queries) :], label[i]):
            found.append((i, j))
            label[label == label[len(queries) + j]] = label[i]
    return found


def _edges(pairs) -> pa.RecordBatch:
    pairs = list(pairs)
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])


def _tokens(values) -> list[np.ndarray]:
    return [np.frombuffer(v, np.uint64) for v in values]


def _verify_groups(num: int, den: int):
    """Links within each group; rows come in the order of groups, so that one group is held at a time."""

    def verify(stream):
        group, rows = None, {}

        def out():
            ids = sorted(rows)
            return _edges((ids[i], ids[j]) for i, j in links_within([rows[i] for i in ids], num, den))

        for batch in stream:
            for sid, component, tokens in zip(*(batch.column(c).to_pylist() for c in ("sid", "component", "tokens"))):
                if component != group and rows:
                    yield out()
                    rows = {}
                group = component
                rows[sid] = np.frombuffer(tokens, np.uint64)
        if rows:
            yield out()

    return verify


def _verify_pivots(num: int, den: int, shared=None):
    """Links of each set to its group's pivots, which come with the row or, by group, in a broadcast."""

    def verify(stream):
        indexes: dict[int, tuple] = {}
        for batch in stream:
            found = []
            for at in range(0, batch.num_rows, 64):  # few rows at a time become Python objects
                part = batch.slice(at, 64)
                columns = [part.column(c).to_pylist() for c in ("sid", "component", "tokens")]
                rows = [shared.value.get(c, ()) for c in columns[1]] if shared else [[(p["sid"], p["tokens"]) for p in x] for x in part.column("pivots").to_pylist()]
                for sid, component, tokens, pivots in zip(*columns, rows):
                    if component not in indexes:
                        if len(indexes) > 64:
                            indexes.clear()
                        ids = [s for s, _ in pivots]
                        indexes[component] = ids, Index(_tokens(t for _, t in pivots))
                    ids, index = indexes[component]
                    own = ids.index(sid) if sid in ids else -1
                    found += [(sid, ids[j]) for j in index.search(np.frombuffer(tokens, np.uint64), num, den, np.arange(len(ids)), own)]
            yield _edges(found)

    return verify


def _pivot_links(large: DataFrame, pivots: DataFrame, num: int, den: int) -> DataFrame:
    """pivots: component, sid, tokens. A broadcast once they were counted and found few and light; else a join by group."""
    held = pivots.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("tokens")), F.lit(0)).alias("size")).first()
    if held["n"] <= 10_000 and held["size"] <= 32 << 20:
        by_group: dict[int, list] = {}
        for r in pivots.collect():
            by_group.setdefault(r["component"], []).append((r["sid"], bytes(r["tokens"])))
        shared = large.sparkSession.sparkContext.broadcast(by_group)
        return large.mapInArrow(lean(_verify_pivots(num, den, shared)), "a long, b long")
    grouped = pivots.groupBy("component").agg(F.collect_list(F.struct("sid", "tokens")).alias("pivots"))
    return large.join(grouped, "component").mapInArrow(lean(_verify_pivots(num, den)), "a long, b long")


def _verify_tiles(num: int, den: int):
    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left.column("sid").to_pylist(), right.column("sid").to_pylist()
        labels = np.concatenate([left.column("label").to_numpy(), right.column("label").to_numpy()])
        found = links_between(_tokens(left.column("tokens").to_pylist()), _tokens(right.column("tokens").to_pylist()), labels, num, den)
        return pa.Table.from_batches([_edges((a[i], b[j]) for i, j in found)])

    return verify


def _links_of_large(large: DataFrame, scratch: Scratch, num: int, den: int) -> list[DataFrame]:
    """Links that connect the classes within large candidate groups (sid, component, tokens).

    Sets that can have no link go; the others form new groups by stricter keys, of which the small ones are searched in
    one piece. In a group that is still large, rounds of a few pivots connect most of its near copies in linear work; the
    sets that are then not in the group's largest class meet the sets of fitting sizes in tiles, but for
    pairs already connected; so no link between classes is lost.
    """
    few = scratch.cut(able(large, num, den).select("sid"), "able")
    rows = scratch.cut(large.select("sid", "tokens").join(broadcast_if_small(few), "sid"), "rows")
    groups = components(tokens_edges(rows, num, den).distinct(), scratch)
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1")
    member = scratch.cut(groups.join(sizes, "component").select(F.col("node").alias("sid"), "component", "sets"), "member")
    rows = scratch.cut(rows.join(broadcast_if_small(member), "sid").select("sid", "component", "sets", "tokens"), "grouped")
    links = [scratch.cut(_links_of_small(rows.filter(F.col("sets") <= GROUP_SETS), num, den), "links")]
    rows = rows.filter(F.col("sets") > GROUP_SETS).drop("sets")
    fit = scratch.cut(able(rows, num, den), "able")
    if fit.isEmpty():
        return links
    rows = scratch.cut(rows.join(broadcast_if_small(fit.drop("component")), "sid"), "fitting")
    return links + _links_by_pivots(rows, scratch, num, den)


def _links_of_small(small: DataFrame, num: int, den: int) -> DataFrame:
    dealt = small.select("sid", "component", "tokens").repartition(shuffle_parts(small.sparkSession), "component").sortWithinPartitions("component")
    return dealt.mapInArrow(lean(_verify_groups(num, den)), "a long, b long")


def _links_by_pivots(rows: DataFrame, scratch: Scratch, num: int, den: int) -> list[DataFrame]:
    """rows: sid, component, tokens, n, least, most, as :func:`able` gives them."""
    links: list[DataFrame] = []
    labels = scratch.cut(rows.select("sid", "component", F.col("sid").alias("label"), F.lit(False).alias("settled")), "labels")
    for k in range(PIVOT_ROUNDS):
        order = Window.partitionBy("component").orderBy(F.xxhash64("sid", F.lit(k)), "sid")
        chosen = labels.filter(~F.col("settled")).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= PIVOTS)
        pivots = scratch.cut(rows.join(broadcast_if_small(chosen.select("sid")), "sid").select("component", "sid", "tokens"), "pivots")
        links.append(scratch.cut(_pivot_links(rows.select("sid", "component", "tokens"), pivots, num, den), "links"))
        joined = links[0]
        for more in links[1:]:
            joined = joined.unionByName(more)
        classes = components(joined, scratch)
        now = rows.select("sid", "component").join(classes.select(F.col("node").alias("sid"), F.col("component").alias("label")), "sid", "left")
        now = scratch.cut(now.select("sid", "component", F.coalesce("label", "sid").alias("label")), "classes")
        counts = now.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.max(F.struct("n", "label")).alias("most"))
        labels = scratch.cut(
            now.join(broadcast_if_small(scratch.cut(counts, "most")), "component").select("sid", "component", "label", (F.col("label") == F.col("most.label")).alias("settled")),
            "labels",
        )
        if labels.filter(~F.col("settled")).isEmpty():
            return links
    # blocks of sets of about one size, of bounded sets and hashes; an open set meets the blocks of the sizes that it can link with
    bucket = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(1.0 + (den - num) / (4.0 * den)))).cast("int")
    sets = rows.join(labels.select("sid", "label", "settled"), "sid").select("sid", "component", "label", "settled", "n", "least", "most", bucket(F.col("n")).alias("bucket"))
    sets = scratch.cut(sets, "sets")
    blocks = sets.groupBy("component", "bucket").agg(F.greatest(F.ceil(F.sum("n") / TILE_TOKENS), F.ceil(F.count(F.lit(1)) / TILE_SETS)).cast("int").alias("blocks"))
    blocks = broadcast_if_small(scratch.cut(blocks, "blocks"))
    block = F.pmod(F.xxhash64("sid", F.lit(8)), F.col("blocks")).cast("int").alias("block")
    right = sets.join(blocks, ["component", "bucket"]).select("sid", "component", "label", "bucket", block)
    asked = sets.filter(~F.col("settled")).select("sid", "component", "label", "n", F.explode(F.sequence(bucket(F.col("least")), bucket(F.col("most")))).alias("bucket"))
    asked = asked.join(blocks, ["component", "bucket"]).select("sid", "component", "label", "n", "bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    asked = scratch.cut(asked, "asked")
    place = ["component", "bucket", "block"]
    chunks = asked.groupBy(*place).agg(F.greatest(F.ceil(F.sum("n") / TILE_TOKENS), F.ceil(F.count(F.lit(1)) / TILE_SETS)).cast("int").alias("chunks"))
    chunks = broadcast_if_small(scratch.cut(chunks, "chunks"))
    tokens = rows.select("sid", "tokens")
    left = asked.join(chunks, place).select("sid", "label", *place, F.pmod(F.xxhash64("sid", F.lit(7)), F.col("chunks")).cast("int").alias("chunk")).join(tokens, "sid")
    right = right.join(chunks, place).select("sid", "label", *place, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).join(tokens, "sid")
    tile = [*place, "chunk"]
    left, right = scratch.cut(left, "left"), scratch.cut(right, "right")
    links.append(left.groupBy(*tile).cogroup(right.groupBy(*tile)).applyInArrow(_verify_tiles(num, den), "a long, b long"))
    return links


# ---- the join ----------------------------------------------------------------------------------


def similar_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, first, rid.

    rid numbers the rows; with ``row_col`` it is that column, a distinct long. first marks one row of
    each component, one of the smallest id.

    Two documents link when den * intersection >= num * union of their sets of
    n-word shingles (fewer words: the whole sequence as one shingle). component_id is the smallest id
    reachable by links. A null, empty or blank text has no shingles and is its own component. Rows of
    equal sets are one node from the start, so groups of copies of any size cost one set. Null ids
    count last: a component has a null id only if all its ids are null.

    Steps: set ids; keys that any two linked sets share (see :func:`keys`); candidate groups, the
    components over shared keys; T-occurrence search (DivideSkip) within them, so that every
    result rests on an exact overlap; components over the links.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    columns = {"doc_id": id_col, "text": text_col}
    base = pick(docs, **columns, rid=row_col) if row_col else numbered(pick(docs, **columns))
    kind = dict(base.dtypes)["doc_id"]

    def sized(stream):
        for batch in stream:
            size, sid = [], []
            for _, tokens in shingle_sets(batch.column(2), n):
                size.append(len(tokens))
                sid.append(set_id(tokens) if len(tokens) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(sid, pa.int64())], ["rid", "doc_id", "n_shingles", "sid"])

    sets = scratch.cut(base.select("rid", "doc_id", "text").mapInArrow(lean(sized), f"rid long, doc_id {kind}, n_shingles long, sid long"), "sets")
    texts = base.select("text")
    bitmap = frequent_cells(texts, n, sets.agg(F.sum("n_shingles")).first()[0] or 0)
    groups = components(candidate_edges(texts, n, num, den, bitmap).distinct(), scratch)
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("sets"))
    chosen = sets.filter("sid is not null").groupBy("sid").agg(F.min("rid").alias("rid"))
    members = scratch.cut(
        scratch.cut(groups.join(chosen, groups["node"] == chosen["sid"]).select("sid", "rid", "component"), "chosen").join(scratch.cut(sizes, "sizes"), "component"), "members"
    )

    def fetched(stream):
        for batch in stream:
            tokens = [t.tobytes() for _, t in shingle_sets(batch.column(3), n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(tokens, pa.binary())], ["sid", "component", "sets", "tokens"])

    with_tokens = scratch.cut(
        base.select("rid", "text").join(broadcast_if_small(members), "rid").select("sid", "component", "sets", "text").mapInArrow(lean(fetched), "sid long, component long, sets long, tokens binary"),
        "tokens",
    )
    links = [_links_of_small(with_tokens.filter(F.col("sets") <= GROUP_SETS), num, den)]
    large = with_tokens.filter(F.col("sets") > GROUP_SETS).select("sid", "component", "tokens")
    if not large.isEmpty():
        links += _links_of_large(scratch.cut(large, "large"), scratch, num, den)
    joined = links[0]
    for more in links[1:]:
        joined = joined.unionByName(more)
    classes = components(joined, scratch)
    classed = sets.join(classes, sets["sid"] == classes["node"], "left").select("rid", "doc_id", "n_shingles", F.coalesce("component", "sid").alias("class"))
    classed = scratch.cut(classed, "classed")
    by_id = F.struct(F.col("doc_id").isNull(), "doc_id", "rid")
    firsts = scratch.cut(classed.filter("class is not null").groupBy("class").agg(F.min(by_id).alias("lead")), "firsts")
    alone = F.col("class").isNull()
    scratch.keep_only(classed, firsts)
    return classed.join(firsts, "class", "left").select(
        "doc_id",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("lead.doc_id")).alias("component_id"),
        (alone | (F.col("rid") == F.col("lead.rid"))).alias("first"),
        "rid",
    )
