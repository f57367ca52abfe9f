"""The pandas helpers: brace-balanced spans and balanced JSON."""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# The header patterns.
CONTRACT_HEADER = re.compile(r"^\s*(abstract\s+)?(contract|interface|library)\s+(\w+)(?:\s+is\s+([^{]+))?\s*\{")
FUNCTION_HEADER = re.compile(
    r"^\s*function\s+(\w+|fallback|receive)\s*\(([^)]*)\)(?:\s+(external|public|internal|private))?(?:\s+(pure|view|payable))?(?:\s+([^{]*?))?(?:\s*returns\s*\(([^)]*)\))?\s*\{"
)

CONTRACT_SPANS = "array<struct<name: string, contract_type: string, inherits: array<string>, line_start: int, line_end: int, body: string>>"
FUNCTION_SPANS = (
    "array<struct<name: string, parameters: array<string>, visibility: string, mutability: string, modifiers: array<string>, return_types: array<string>, "
    "first: int, lines: int, body: string>>"
)


class Braces:
    """Brace balance after each line, and where a balance next occurs; one pass over the text."""

    def __init__(self, lines: list[str]):
        self.after, self.where, level = [0], {}, 0
        for i, line in enumerate(lines):
            level += line.count("{") - line.count("}")
            self.after.append(level)
            self.where.setdefault(level, []).append(i)

    def end(self, start: int) -> int | None:
        """The first line from ``start`` on after which the balance is what it was before ``start``."""
        at = self.where.get(self.after[start], [])
        k = bisect.bisect_left(at, start)
        return at[k] if k < len(at) else None


def contract_spans(text: str | None) -> list[tuple]:
    lines = (text or "").split("\n")
    braces, found, free = Braces(lines), [], 0
    for i, line in enumerate(lines):
        m = CONTRACT_HEADER.match(line) if i >= free else None
        end = braces.end(i) if m else None
        if end is None:
            continue
        parents = [p.strip().split("(")[0] for p in (m[4] or "").split(",") if p.strip()]
        found.append((m[3], "abstract" if m[1] else m[2], parents, i + 1, end + 1, "\n".join(lines[i : end + 1])))
        free = end + 1
    return found


def function_spans(body: str | None) -> list[tuple]:
    lines = (body or "").split("\n")
    braces, found = Braces(lines), []
    items = lambda text, by: [x.strip() for x in (text or "").split(by) if x.strip()]
    for i, line in enumerate(lines):
        m = FUNCTION_HEADER.search(line)
        if m:
            end = braces.end(i)
            end = len(lines) - 1 if end is None else end
            part = "\n".join(lines[i : end + 1])
            found.append((m[1], items(m[2], ","), m[3] or "public", m[4] or "nonpayable", items(m[5], None), items(m[6], ","), i, end - i + 1, part))
    return found


def first_json(text: str | None) -> str | None:
    """The first balanced {...}, or null."""
    level, start = 0, -1
    for m in re.finditer(r"[{}]", text or ""):
        if m[0] == "{":
            start = m.start() if start < 0 else start
            level += 1
        elif start >= 0:
            level -= 1
            if level == 0:
                return text[start : m.end()]
    return None


def _contracts(content: pd.Series) -> pd.Series:
    return content.map(contract_spans)


def _functions(body: pd.Series) -> pd.Series:
    return body.map(function_spans)


def _first_json(text: pd.Series) -> pd.Series:
    return text.map(first_json)


def parse_contract_spans(content: ColumnOrName) -> Column:
    return F.pandas_udf(_contracts, CONTRACT_SPANS)(content)


def parse_function_spans(body: ColumnOrName) -> Column:
    return F.pandas_udf(_functions, FUNCTION_SPANS)(body)


def first_json_object(text: ColumnOrName) -> Column:
    return F.pandas_udf(_first_json, "string")(text)
