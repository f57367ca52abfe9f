"""Repair of conversation structure: cheapest edits by dynamic programming shared over a prefix trie of signatures."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import Scratch, broadcast_if_small, pick
from ._memory import lean

#: What separates words: blank, and code points 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
#: Adjacent initials that are in order.
LEGAL = {"su", "ua", "au"}
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: Costs of edits, and of keeping a truncated turn.
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED = 3
#: States of s?(ua)+: nothing yet, after the system turn, after a user turn, after an assistant turn. Next by initial; states that may end.
STEP = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ENDS = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
#: Inserts between two turns: with more than two the same state is reached for less.
MOST_INSERTS = 2
#: The symbol of a turn that must go; others are the initial, in capitals where the turn is truncated.
MUST_GO, OTHER = "x", "o"

SIGNED = pa.schema([("conv_id", pa.int64())] + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")] + [("signature", pa.string())])
SIGNED_SQL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"
ANSWERED = pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])
REPAIRED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
#: Rows, or bytes of text, that a batch of repaired turns has before it is sent on.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20


def _forced(state: int) -> str:
    """The initial of a turn whose role may be chosen in this state: always one."""
    return "a" if state == 2 else "u"


def _inserted() -> dict[int, list[tuple[int, int]]]:
    out = {}
    for state in STEP:
        at, out[state] = state, [(0, state)]
        for m in range(1, MOST_INSERTS + 1):
            at = STEP[at][_forced(at)]
            out[state].append((m, at))
    return out


INSERTED = _inserted()

#: A layer: state -> (cost, rank, state before, letters since). Ranks order the states' letter strings; strings of a layer end with the letter of the same turn,
#: so none begins another, and of two that differ the order never changes whatever follows.
Layer = dict[int, tuple[int, int, int, str]]
ROOT: Layer = {0: (0, 0, -1, "")}


def next_layer(layer: Layer, symbol: str) -> Layer:
    """The best letters up to and with the turn of this symbol, for each state that they can lead to."""
    initial, more = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    best: dict[int, tuple] = {}
    for before, (cost, rank, _, _) in layer.items():
        for m, state in INSERTED[before]:
            edits = [(DELETE, state, 0)]
            if symbol != MUST_GO:
                edits.append((REROLE, STEP[state][_forced(state)], more))
                if initial in STEP[state]:
                    edits.append((KEEP, STEP[state][initial], more))
            for letter, to, added in edits:
                found = (cost + m * COST[INSERT] + COST[letter] + added, rank, INSERT * m + letter, before)
                if to not in best or found < best[to]:
                    best[to] = found
    ranks = {to: i for i, to in enumerate(sorted(best, key=lambda to: best[to][1:3]))}
    return {to: (cost, ranks[to], before, letters) for to, (cost, _, letters, before) in best.items()}


def answer(layers: list[Layer]) -> tuple[int, str]:
    """(cost, audit) at the end of a signature, from the layers of its prefixes, the root's first."""
    cost, _, tail, state = min((cost + m * COST[INSERT], rank, INSERT * m, state) for state, (cost, rank, _, _) in layers[-1].items() for m, end in INSERTED[state] if end in ENDS)
    parts = [tail]
    for layer in reversed(layers[1:]):
        _, _, before, letters = layer[state]
        parts.append(letters)
        state = before
    return cost, "".join(reversed(parts))


def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of sorted signatures. In sorted order a trie is walked depth first: layers of the shared prefix stay, the rest are new."""
    layers, known = [ROOT], ""
    for batch in batches:
        rows = []
        for signature in batch.column(0).to_pylist():
            shared = 0
            for x, y in zip(known, signature):
                if x != y:
                    break
                shared += 1
            del layers[shared + 1 :]
            for symbol in signature[shared:]:
                layers.append(next_layer(layers[-1], symbol))
            known = signature
            rows.append((signature, *answer(layers)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), ANSWERED.types)], schema=ANSWERED)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and signatures of conversations whose rows (conv_id, turn, role, blank, truncated, first, copies) come in order, one after the other."""
    held: list = []
    nothing = object()
    conv, state = nothing, None

    def end():
        turns, last, counts, signature = state["turns"], state["last"], state["counts"], state["signature"]
        gaps = last - state["first"] + 1 - turns if turns else 0
        held.append((conv, gaps, *counts, "".join(signature)))

    for batch in batches:
        for conv_id, turn, initial, blank, truncated, first, copies in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if conv_id != conv or conv is nothing:
                if conv is not nothing:
                    end()
                conv, state = conv_id, {"turns": 0, "first": None, "last": None, "counts": [0, 0, 0, 0], "signature": [], "before": None}
            if turn is not None and turn != state["last"]:
                state["first"] = turn if state["first"] is None else state["first"]
                state["turns"], state["last"] = state["turns"] + 1, turn
            counts, before = state["counts"], state["before"]
            if before is not None and before + initial not in LEGAL:
                counts[3] += 1
            counts[3] += copies - 1  # equal initials are never in order
            state["before"] = initial
            if blank:
                counts[0] += copies
                state["signature"].append(MUST_GO * copies)
                continue
            counts[1] += copies - 1 if first else copies
            counts[2] += 1 if first and truncated else 0
            kind = initial if initial in ("s", "u", "a") else OTHER
            state["signature"].append((kind.upper() if truncated else kind) + MUST_GO * (copies - 1) if first else MUST_GO * copies)
        if len(held) >= BATCH_ROWS:
            yield _batch(held, SIGNED)
            held.clear()
    if conv is not nothing:
        end()
    yield _batch(held, SIGNED)


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ((),) * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns of conversations whose audit comes first and then their rows in order. Holds a batch and an audit at a time."""
    held: list = []
    size, nothing = 0, object()
    conv, audit, at, state, place = nothing, "", 0, 0, 0

    def give(role: str, text: str, edit: str, initial: str) -> None:
        nonlocal state, place, size
        held.append((conv, place, role, text, edit))
        state, place, size = STEP[state][initial], place + 1, size + len(text)

    def insert() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == INSERT:
            initial = _forced(state)
            give(NAMES[initial], "", INSERT, initial)
            at += 1

    for batch in batches:
        for conv_id, told, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text"))):
            if told is not None:
                insert()
                conv, audit, at, state, place = conv_id, told, 0, 0, 0
                continue
            insert()
            letter, at = audit[at], at + 1
            if letter == REROLE:
                give(NAMES[_forced(state)], text, REROLE, _forced(state))
            elif letter == KEEP:
                give(role, text, KEEP, role[:1])
            if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield _batch(held, REPAIRED)
                held.clear()
                size = 0
    insert()
    yield _batch(held, REPAIRED)


def _turns(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, turn, role, text, digest; null roles and texts are one space."""
    rows = pick(turns, conv_id=id_col, turn=turn_col, role=role_col, text=text_col)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))


#: The order of a conversation's rows.
ORDER = ["turn", "role", "digest"]


def audit(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit for each conversation, its rows taken by turn, nulls first.

    Each turn counts for its first fault: blank text, role and text seen earlier, or an end without one of ``.!?``. Gaps are turn numbers
    missing between the least and the greatest; illegal counts neighbours whose initials are not su, ua or au. The audit is the
    cheapest string of edits (K keep, R give the role user or assistant, D delete, I insert an empty turn of either) after which
    initials read ``(s?(ua)+)?``; of equally cheap ones the least. Blank and repeated turns must go; a truncated turn that stays costs more.

    Slim facts of turns move, never texts; equal rows are counted before they move. A conversation's facts are streamed in order into a signature of a letter a
    turn. Distinct signatures are sorted over range partitions and walked as a prefix trie: a layer of the dynamic program is
    computed once for all signatures that share the prefix, holds four states with back references, and answers are read at
    ends of signatures. A task holds one path of the trie and one conversation's letters, never its texts.

    Null roles and texts are one space, and so blank; null conversation ids are one conversation. Rows of one turn go by role and the text's digest.
    An empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(turns.sparkSession)
    rows = _turns(turns, id_col, turn_col, role_col, text_col)
    stripped = F.rtrim(F.col("text"), F.lit(BLANKS))
    facts = rows.select("conv_id", *ORDER, (stripped == "").alias("blank"), (~F.substring(stripped, -1, 1).isin(".", "!", "?")).alias("truncated"))
    facts = facts.groupBy("conv_id", *ORDER, "blank", "truncated").agg(F.count(F.lit(1)).alias("copies"))
    earlier = Window.partitionBy("conv_id", "role", "digest").orderBy("turn")
    facts = facts.withColumn("first", F.row_number().over(earlier) == 1)
    streamed = facts.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER).select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "blank", "truncated", "first", "copies")
    signed = scratch.cut(streamed.mapInArrow(lean(_sign), SIGNED_SQL), "signatures")
    distinct = signed.groupBy("signature").agg(F.count(F.lit(1)).alias("n")).select("signature")
    answers = scratch.cut(distinct.repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(lean(solve), "signature string, cost long, audit string"), "answers")
    return signed.join(broadcast_if_small(answers, 100_000), "signature").drop("signature")


def repaired(turns: DataFrame, audits: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, place, role, text, edit: the turns that stay or are inserted, by the audits of :func:`audit`.

    A conversation's rows are in one partition, in order. Texts are streamed: an audit comes first, then
    its rows; a task holds one batch of them. Conversations without turns that stay have no rows.
    """
    rows = _turns(turns, id_col, turn_col, role_col, text_col)
    none = lambda kind: F.lit(None).cast(kind)
    first = audits.select("conv_id", F.lit(0).alias("kind"), none("long").alias("turn"), none("string").alias("role"), none("binary").alias("digest"), none("string").alias("text"), "audit")
    both = first.unionByName(rows.withColumn("kind", F.lit(1)).withColumn("audit", none("string")))
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER)
    return ordered.select("conv_id", "audit", "role", "text").mapInArrow(lean(_apply), "conv_id long, place long, role string, text string, edit string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    out, nothing = [], object()
    conv, held = nothing, None
    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if conv is nothing or conv_id != conv:
                if conv is not nothing:
                    out.append((conv, held.hexdigest()))
                conv, held = conv_id, hashlib.sha256()
            else:
                held.update(b"\n")
            held.update(f"{role}:{text}".encode())
    if conv is not nothing:
        out.append((conv, held.hexdigest()))
    yield _batch(out, pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))


def digests(rows: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the rows of :func:`repaired` as role:text lines; the hash runs along the stream, so texts are never joined."""
    return rows.select("conv_id", "role", "text").mapInArrow(lean(_digest), "conv_id long, repaired_sha256 string")


def damaged(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", out_of: int = 20) -> DataFrame:
    """conv_id, turn, role, text of turns damaged by a checksum of id and turn: dropped, emptied, without end marks, repeated, or of role user. Nulls are one space."""
    rows = pick(turns, conv_id=id_col, turn=turn_col, role=role_col, text=text_col)
    told: dict[str, Column] = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    rows = rows.select("conv_id", "turn", told["role"].alias("role"), told["text"].alias("text"), (F.crc32(F.concat_ws(":", told["conv_id"], told["turn"])) % out_of).alias("h")).filter("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("h") == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")
