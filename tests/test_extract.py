"""Golden cases of the source patterns, quirks included."""

import json

import pytest
from pyspark.sql import functions as F

from auditjobs.functions import deep as deep_json
from auditjobs.functions import spans
from auditjobs.operators import extract as E

SOURCE = """pragma solidity ^0.8.20;
abstract contract Vault is Ownable, Pausable(1) {
    using SafeMath for uint256;
    event Paid(address to);
    error Denied(address who);
    mapping(address => uint) public balances;
    Token public token;
    modifier onlyKeeper() { _; }
    function withdraw(uint amount) external payable onlyOwner returns (bool) {
        token.transfer(msg.sender, amount);
        total = total - amount;
        _log(amount);
    }
}
"""


def rows(spark, content, path="a.sol"):
    return spark.createDataFrame([("r", path, content)], "repo string, path string, content string")


def test_contract_and_function(spark):
    contract = E.extract_contracts(rows(spark, SOURCE))
    c = contract.first()
    assert (c.name, c.contract_type, c.inherits, c.line_start, c.line_end) == ("Vault", "abstract", ["Ownable", "Pausable"], 2, 14)
    f = E.extract_storage_access(E.extract_calls(E.extract_functions(contract))).first()
    assert (f.name, f.visibility, f.mutability, f.modifiers, f.parameters, f.return_types) == ("withdraw", "external", "payable", ["onlyOwner"], ["uint amount"], ["bool"])
    assert (f.line_start, f.line_end) == (9, 13)
    assert f.calls == ["_log", "returns", "token.transfer", "withdraw"]
    assert f.storage_writes == ["total"]
    assert "amount" in f.storage_reads and "total" not in f.storage_reads
    assert {(v["var"], v.var_type) for v in E.extract_state_vars(contract).collect()} >= {("balances", "mapping(address => uint)"), ("token", "Token")}
    assert [r.name for r in E.extract_decls(contract, "event").collect()] == ["Paid"]
    assert [r.name for r in E.extract_uses(contract).collect()] == ["SafeMath"]


@pytest.mark.parametrize(
    "text, names",
    [
        ("contract A\n{\n}", []),  # brace on the next line
        ("contract A {\n", []),  # unbalanced
        ("contract A {}\ncontract B {\n}", ["A", "B"]),
        ("contract A {\n  contract B {\n  }\n}", ["A"]),  # the scan goes on after the body
        ("", []),
        (None, []),
    ],
)
def test_contract_headers(text, names):
    assert [s[0] for s in spans.contract_spans(text)] == names


def test_last_function_of_a_name_wins(spark):
    text = "contract A {\n function f(uint a) public {\n }\n function f() private {\n }\n}"
    found = E.extract_functions(E.extract_contracts(rows(spark, text))).collect()
    assert [(f.name, f.visibility, f.line_start) for f in found] == [("f", "private", 4)]


@pytest.mark.parametrize(
    "line, found",
    [
        ("uint publicKey;", [("Key", "uint")]),
        ("return x;", [("x", "return")]),
        ("mapping(address => mapping(address => uint)) m;", []),
        ("bool a = true;", [("a", "bool")]),
    ],
)
def test_state_variable_quirks(spark, line, found):
    rows_ = spark.createDataFrame([("r", "A", f"contract A {{\n{line}\n}}")], "repo string, name string, body string")
    assert [(v["var"], v.var_type) for v in E.extract_state_vars(rows_).collect()] == found


@pytest.mark.parametrize(
    "body, calls",
    [
        ("require(f(x));", []),  # the inner call is lost
        ("x.call{value: v}(d);", []),
        ("this.f(); a . b (1)", ["a.b", "b"]),  # a blank hides the dot
        ("naïve(1)", ["naïve"]),
    ],
)
def test_call_quirks(spark, body, calls):
    df = spark.createDataFrame([(body,)], "body string")
    assert df.select(E.calls_of(F.col("body"))).first()[0] == calls


def test_call_options(spark):
    df = spark.createDataFrame([("x.call{value: v}(d);",)], "body string")
    assert "x.call" in df.select(E.calls_of(F.col("body"), True)).first()[0]


def test_writes_and_reads(spark):
    df = spark.createDataFrame([("m[k] -= v; a = b; c += 1; d => e;",)], "body string")
    writes, reads = df.select(E.writes_of(F.col("body")), E.reads_of(F.col("body"))).first()
    assert writes == ["a", "c", "d"]
    assert reads == ["b", "e", "k", "m", "v"]


def test_pragma(spark):
    assert E.extract_pragma(rows(spark, SOURCE)).first()[2:] == ("^0.8.20", "0.8.20")
    assert E.extract_pragma(rows(spark, "x")).first()[2:] == (None, None)


@pytest.mark.parametrize("text, found", [('say {"a": {"b": 1}} and {', '{"a": {"b": 1}}'), ("} {x}", "{x}"), ("none", None), ("{ open", None)])
def test_first_json(text, found):
    assert spans.first_json(text) == found


def walked(text):
    """Brute force: a pre-order walk with keys in sorted order."""
    try:
        todo = [json.loads(text or "[]")]
    except ValueError:
        todo = []
    contract = function = ""
    place = None
    while todo:
        value = todo.pop()
        if isinstance(value, list):
            todo += reversed(value)
        elif isinstance(value, dict):
            name = value.get("name")
            if isinstance(name, str) and name:
                contract = contract or (name if value.get("type") == "contract" else "")
                function = function or (name if value.get("type") == "function" else "")
            at = value.get("source_mapping")
            if place is None and isinstance(at, dict) and at.get("lines"):
                place = (at.get("filename_relative") or at.get("filename_short") or at.get("filename_absolute") or "", min(at["lines"]), max(at["lines"]))
            todo += [value[k] for k in sorted(value, reverse=True)]
    return (contract, function, *(place or ("", None, None)))


def test_deep_walk(spark):
    node = '{"type": "function", "name": "f", "type_specific_fields": {"parent": {"type": "x", "name": "", "p": {"q": {"r": {"type": "contract", "name": "C", "source_mapping": {"lines": [9, 7], "filename_relative": "", "filename_short": "s.sol"}}}}}}}'
    assert walked(f"[{node}]") == ("C", "f", "s.sol", 7, 9)
    deep = node
    for _ in range(30):
        deep = f'{{"x": [1, "[{{\\" {{", {deep}], "name": 5, "type": "contract"}}'
    texts = [f"[{node}]", "broken", None, "", "[]", "7", '"[x"', f"[{deep}]", f"[[], {{}}, null, {deep}, {node}]", '[{"type": "contract", "name": "A", "source_mapping": {"lines": []}}, {"type": "contract", "name": "B", "source_mapping": null}]']
    table = spark.createDataFrame(list(enumerate(texts)), "i int, e string")
    found = table.select("i", deep_json.walk_elements_json("e").alias("w"))
    assert "Python" not in found._jdf.queryExecution().toString()
    assert {r.i: tuple(r.w) for r in found.collect()} == {i: walked(t) for i, t in enumerate(texts)}
    assert table.limit(0).select(deep_json.walk_elements_json("e")).count() == 0
