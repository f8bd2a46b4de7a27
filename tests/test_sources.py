"""The index source, symbols, extraction and reports, on hand-made rows."""

import json

import pytest

from unitflow.plans import report
from unitflow.plans.extract import extract
from unitflow.sources.scip import decode, parse_symbol, read_index


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def occurrence(symbol, place, definition=False, enclosing=()):
    out = field(1, b"".join(map(varint, place))) + field(2, symbol)
    return out + (field(3, 1) if definition else b"") + (field(7, b"".join(map(varint, enclosing))) if enclosing else b"")


S = "scip-x m pkg v1 "
TEXT = "class Box\n  def get\n    help()\n  end\nend\ndef help\n  print()\n  get()\nend\n"


@pytest.fixture(scope="module")
def index(tmp_path_factory):
    symbols = [(S + "a/Box#", 7), (S + "a/Box#get().", 26), (S + "a/help().", 17), (S + "a/help().", 17)]
    doc = field(1, "src/a.x") + field(4, "X") + field(5, TEXT)
    doc += b"".join(field(3, field(1, s) + field(3, "doc of it") + field(5, k)) for s, k in symbols)
    uses = [occurrence(S + "a/Box#", [0, 6, 9], True, [0, 0, 4, 3]), occurrence(S + "a/Box#get().", [1, 6, 9], True, [1, 2, 3, 5]), occurrence(S + "a/help().", [2, 4, 8]), occurrence(S + "a/help().", [5, 4, 8], True)]
    uses += [occurrence("scip-x m std v2 io/print().", [6, 2, 7]), occurrence(S + "a/Box#get().", [7, 2, 5]), occurrence("scip-x m std v2 io/", [6, 2, 7]), occurrence("local 3", [7, 2, 5])]
    doc += b"".join(field(2, u) for u in uses)
    at = tmp_path_factory.mktemp("index") / "index.scip"
    at.write_bytes(field(1, field(3, "file:///proj")) + field(2, doc) + field(3, field(1, "scip-x m std v2 io/print().") + field(6, "print") + field(7, field(5, "def print"))))
    return str(at)


def test_symbols():
    names = lambda s: [(d["name"], d["suffix"]) for d in parse_symbol(s)["descriptors"]]
    assert names(S + "impl#[Counter]bump(+1).") == [("impl", "Type"), ("Counter", "TypeParameter"), ("bump", "Method")]
    assert names(S + "`a b``c`/x.") == [("a b`c", "Namespace"), ("x", "Term")]
    assert parse_symbol("s m . . f().")["package"] == "" and parse_symbol(S + "f(+1).")["descriptors"][0]["disambiguator"] == "+1"
    assert [parse_symbol(s) for s in (None, "", "local 1", "one two", S, S + "x(")] == [None] * 6


def test_bad_index(spark, tmp_path):
    (tmp_path / "bad.scip").write_bytes(b"\x0a\xff\x01x")
    with pytest.raises(ValueError):
        decode(b"\x0a\xff\x01x")
    with pytest.raises(Exception, match="no index"):
        read_index(spark, str(tmp_path / "bad.scip"))["documents"].collect()


def test_extract(spark, index):
    got = extract(spark, index, ["src/*"])
    functions = {r["fn_id"]: r for r in got.functions.collect()}
    get, help_ = "pkg/a.(Box).get", "pkg/a.help"
    assert set(functions) == {get, help_}
    assert functions[get]["body"] == "  def get\n    help()\n  end" and functions[get]["receiver_type"] == "pkg/a.Box"
    assert functions[help_]["body"] == "def help\n  print()\n  get()\nend" and functions[help_]["position"]["Line"] == 6
    assert functions[help_]["position"]["Filename"] == "/proj/src/a.x"
    assert [(r["type_id"], r["kind"], r["methods"]) for r in got.types.collect()] == [("pkg/a.Box", "class", [get])]
    ext = "scip:scip-x m std v2 io/print()."
    assert [(r["ext_id"], r["name"], r["signature"]) for r in got.externals.collect()] == [(ext, "print", "def print")]
    assert sorted(map(tuple, got.edges.collect())) == [(get, help_, 1), (help_, get, 2), (help_, ext, 1)]
    assert [(r["unit_id"], r["callees"], r["externals"]) for r in got.units.collect()] == [(f"{get}+{help_}", [], [ext])]
    assert got.language.first()[0] == "X" and got.warnings.count() == 2
    assert extract(spark, index, ["other/*"]).units.count() == 0


def test_reports(spark, tmp_path):
    where = {"Filename": "a.x", "Offset": 0, "Line": 3, "Column": 1}
    f = {"package": "p", "name": "f", "receiver": "", "signature": "f()", "position": where}
    units = spark.createDataFrame([("p.g", 1, [f], "does g", "", [], []), ("p.f", 0, [f], "", "", [], ["s"])], report.UNITS)
    issues = spark.createDataFrame([("p.g", 0, where, "critical", "security", "bad", "", "mend"), ("p.f", 0, where, "critical", "baseline", "worse", "", ""), ("p.f", 1, None, "low", "baseline", "odd", "", "")], report.ISSUES)
    made = report.assemble(units, issues, {"generated_at": "2020-01-02T03:04:05", "modules": ["m"]})
    assert made["summary"] == {"total_issues": 3, "by_severity": {"critical": 2, "low": 1}, "by_category": {"baseline": 2, "security": 1}, "critical_units": ["p.f", "p.g"]}
    text = report.to_markdown(made)
    assert text.startswith("# Code Review Report\n\nGenerated: 2020-01-02 03:04 | Modules: m\n\n## Summary\n\n| Severity | Count |\n")
    assert "### p.g (a.x:3)\n\n**[CRITICAL] [security]** bad\n> Suggestion: mend\n\n---\n" in text and "High Priority" not in text
    run = json.loads(report.to_sarif(made))["runs"][0]
    assert [r["level"] for r in run["results"]] == ["error", "note", "error"] and "locations" not in run["results"][1] and run["results"][2]["fixes"]
    report.write_report(made, "json", {"json": str(tmp_path / "r.json")})
    again = report.assemble(*report.read_json(spark, str(tmp_path / "r.json")), made["metadata"])
    assert again["units"] == made["units"] and again["summary"]["by_severity"] == made["summary"]["by_severity"]
