"""Walks of JSON of any depth, as column expressions over variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def json_depth(text: ColumnOrName) -> Column:
    """How deep the brackets of a JSON text nest; those inside strings do not count."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), '"[^"]*"', "")
    bracket = F.regexp_extract_all(bare, F.lit(r"[\[\]{}]"), F.lit(0))

    def step(state: Column, one: Column) -> Column:
        level = state["level"] + F.when(one.isin("[", "{"), 1).otherwise(-1)
        return F.struct(level.alias("level"), F.greatest(state["most"], level).alias("most"))

    return F.aggregate(bracket, F.struct(F.lit(0).alias("level"), F.lit(0).alias("most")), step, lambda s: s["most"])


def json_nodes(text: ColumnOrName) -> Column:
    """array<struct<v: variant, open: boolean>>: every value of a JSON text, parents before children, keys in sorted order.

    Each pass puts the children of the values found last after their parents; a text takes as many passes as it is deep.
    Null and broken texts, and objects that repeat a key, give one null value.
    """
    node = lambda v, new: F.struct(v.alias("v"), F.lit(new).alias("open"))

    def below(n: Column) -> Column:
        items = F.try_variant_get(n["v"], "$", "array<variant>")
        values = F.map_values(F.try_variant_get(n["v"], "$", "map<string,variant>"))
        return F.transform(F.coalesce(items, values, F.array().cast("array<variant>")), lambda c: node(c, True))

    def widen(nodes: Column, _: Column) -> Column:
        return F.flatten(F.transform(nodes, lambda n: F.when(n["open"], F.concat(F.array(node(n["v"], False)), below(n))).otherwise(F.array(n))))

    return F.aggregate(F.sequence(F.lit(0), F.coalesce(json_depth(text), F.lit(0))), F.array(node(F.try_parse_json(text), True)), widen)


def walk_elements_json(elements: ColumnOrName) -> Column:
    """struct<contract, function, file, line_start, line_end> of elements as JSON of any depth.

    The first named contract and function count, and the first node with lines; '' and null where there is none.
    """
    at = "$.source_mapping"
    text = lambda n, path: F.try_variant_get(n["v"], path, "string")
    named = lambda n: (F.schema_of_variant(F.try_variant_get(n["v"], "$.name", "variant")) == "STRING") & (text(n, "$.name") != "")
    facts = F.transform(
        json_nodes(elements),
        lambda n: F.struct(
            F.when(named(n), text(n, "$.type")).alias("type"),
            text(n, "$.name").alias("name"),
            F.try_variant_get(n["v"], f"{at}.lines", "array<int>").alias("lines"),
            F.coalesce(*(F.nullif(text(n, f"{at}.filename_{kind}"), F.lit("")) for kind in ("relative", "short", "absolute")), F.lit("")).alias("file"),
        ),
    )

    def found(rows: Column) -> Column:
        first = lambda kind: F.coalesce(F.get(F.filter(rows, lambda r: r["type"] == kind), F.lit(0))["name"], F.lit(""))
        place = F.get(F.filter(rows, lambda r: F.size(r["lines"]) > 0), F.lit(0))
        return F.struct(
            first("contract").alias("contract"),
            first("function").alias("function"),
            F.coalesce(place["file"], F.lit("")).alias("file"),
            F.array_min(place["lines"]).alias("line_start"),
            F.array_max(place["lines"]).alias("line_end"),
        )

    # one transform over a list of one, so that the walk is evaluated once
    return F.get(F.transform(F.array(facts), found), F.lit(0))
