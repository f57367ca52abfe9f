"""Byte-level BPE encoding and decoding over Arrow batches, with the tokenizers library."""

from __future__ import annotations

import base64
import functools
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._io import pick
from ._memory import lean

#: Texts are encoded in runs of about this many characters, so memory follows the run or one text.
RUN_CHARS = 1 << 20


@functools.lru_cache
def byte_to_char() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest for code points from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def load(path: str, pattern: str):
    """(encoder, bytes of each id) for a file of ranks: one base64 token and its rank a line.

    Every split of a token into two tokens becomes a merge with the rank of the
    token, so any adjacent pair that makes a token may merge, lowest rank first.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    chars = byte_to_char()
    text = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = [
        (text[token[:i]], text[token[i:]])
        for token in sorted(ranks, key=ranks.__getitem__)
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    encoder = Tokenizer(models.BPE(vocab={text[t]: r for t, r in ranks.items()}, merges=merges))
    encoder.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return encoder, table


def encode_texts(texts: list[str], path: str, pattern: str, offsets: bool = False) -> Iterator[tuple[np.ndarray, list | None]]:
    """Ids of each text, and with ``offsets`` the characters [start, end) that each token touches."""
    encoder, _ = load(path, pattern)
    run, chars = [], 0
    encode = encoder.encode_batch if offsets else encoder.encode_batch_fast
    for i, text in enumerate(texts):
        run.append(text)
        chars += len(text)
        if chars >= RUN_CHARS or i + 1 == len(texts):
            for e in encode(run, add_special_tokens=False):
                yield np.array(e.ids, dtype="<u4"), e.offsets if offsets else None
            run, chars = [], 0


def decode_ids(ids, path: str, pattern: str) -> bytes:
    """The bytes of ids. Tokens may hold parts of a character; only their concatenation need be UTF-8."""
    table = load(path, pattern)[1]
    return b"".join([table[i] for i in np.asarray(ids).tolist()])


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """doc_id, ids array<int>, and with ``offsets`` starts and ends array<int> in characters.

    Narrow: one pass of Arrow batches, no shuffle. A null or empty text has no
    ids. Rows with equal or null ids are encoded each on its own.
    """

    def batches(stream):
        for batch in stream:
            out = list(encode_texts([t or "" for t in batch.column(1).to_pylist()], path, pattern, offsets))
            columns = [batch.column(0), pa.array([ids.astype("i4") for ids, _ in out], pa.list_(pa.int32()))]
            names = ["doc_id", "ids"]
            if offsets:
                columns += [pa.array([[o[k] for o in spans] for _, spans in out], pa.list_(pa.int32())) for k in (0, 1)]
                names += ["starts", "ends"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = dict(docs.dtypes)[id_col]
    extra = ", starts array<int>, ends array<int>" if offsets else ""
    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(lean(batches), f"doc_id {kind}, ids array<int>{extra}")


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: the inverse of :func:`encode`. Null ids give an empty text.

    Bytes that do not make whole characters (ids cut from a longer sequence)
    become U+FFFD.
    """

    def batches(stream):
        for batch in stream:
            texts = [decode_ids(ids or [], path, pattern).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = dict(tokens.dtypes)[id_col]
    return pick(tokens, doc_id=id_col, ids=ids_col).mapInArrow(lean(batches), f"doc_id {kind}, text string")


def round_trip_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one pass, only digests kept."""

    def batches(stream):
        for batch in stream:
            n, hashed, decoded = [], [], []
            for ids, _ in encode_texts([t or "" for t in batch.column(1).to_pylist()], path, pattern):
                n.append(len(ids))
                hashed.append(hashlib.sha256(ids.tobytes()).hexdigest())
                decoded.append(hashlib.sha256(decode_ids(ids, path, pattern)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(hashed, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = dict(docs.dtypes)[id_col]
    return pick(docs, doc_id=id_col, text=text_col).mapInArrow(lean(batches), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
