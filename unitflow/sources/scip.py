"""Code indexes in the SCIP wire format as four tables.

Files are read by Spark's binary reader, so any store it knows will do; one task decodes one index (a message is one blob), and
documents, symbols and occurrences come out as rows. Bytes that are no index raise an error.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Fixed: numbers of the symbol kinds that are functions or types.
KINDS = {7: "Class", 9: "Constructor", 11: "Enum", 17: "Function", 21: "Interface", 25: "Macro", 26: "Method", 42: "Protocol", 49: "Struct", 53: "Trait", 54: "Type", 55: "TypeAlias", 56: "TypeClass", 59: "Union", 66: "AbstractMethod", 67: "MethodSpecification", 68: "ProtocolMethod", 69: "PureVirtualMethod", 70: "TraitMethod", 71: "TypeClassMethod", 74: "MethodAlias", 76: "SingletonMethod", 80: "StaticMethod"}
SYMBOL = "struct<ord: int, symbol: string, kind: string, display: string, signature: string, documentation: array<string>>"
DOCUMENT = f"path string, ord int, doc string, language string, text string, root string, symbols array<{SYMBOL}>, occurrences array<struct<ord: int, symbol: string, roles: int, range: array<int>, enclosing: array<int>>>, external boolean"


def _varint(data, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(data) -> dict[int, list]:
    """A message's values by field number: integers, or bytes of length-delimited ones."""
    out, at = {}, 0
    while at < len(data):
        tag, at = _varint(data, at)
        wire = tag & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire in (1, 2, 5):
            size = 8 if wire == 1 else 4
            if wire == 2:
                size, at = _varint(data, at)
            if at + size > len(data):
                raise ValueError("truncated message")
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire}")
        out.setdefault(tag >> 3, []).append(value)
    return out


def _text(found: dict, number: int) -> str:
    return bytes(found[number][-1]).decode("utf-8", "replace") if number in found else ""


def _ints(found: dict, number: int) -> list[int]:
    out = []
    for part in found.get(number, ()):
        if isinstance(part, int):
            out.append(part)
        else:
            at = 0
            while at < len(part):
                value, at = _varint(part, at)
                out.append(value)
    return [v - (1 << 64) if v >> 63 else v for v in out]


def _symbol(data, place: int) -> dict:
    m = fields(data)
    signature = _text(fields(m[7][-1]), 5) if 7 in m else ""
    docs = [bytes(x).decode("utf-8", "replace") for x in m.get(3, ())]
    return {"ord": place, "symbol": _text(m, 1), "kind": KINDS.get(m.get(5, [0])[-1], ""), "display": _text(m, 6), "signature": signature, "documentation": docs}


def decode(data) -> list[dict]:
    """The documents of one index, and one more row (external) with its external symbols."""
    index = fields(data)
    root = _text(fields(index[1][-1]), 3) if 1 in index else ""
    blank = {"language": "", "text": "", "root": root, "symbols": [], "occurrences": [], "external": False}
    out = []
    for k, part in enumerate(index.get(2, ())):
        m = fields(part)
        uses = [fields(x) for x in m.get(2, ())]
        occurrences = [{"ord": j, "symbol": _text(u, 2), "roles": u.get(3, [0])[-1], "range": _ints(u, 1), "enclosing": _ints(u, 7)} for j, u in enumerate(uses)]
        out.append(blank | {"ord": k, "doc": _text(m, 1), "language": _text(m, 4), "text": _text(m, 5), "symbols": [_symbol(x, j) for j, x in enumerate(m.get(3, ()))], "occurrences": occurrences})
    return [*out, blank | {"ord": len(out), "doc": "", "external": True, "symbols": [_symbol(x, j) for j, x in enumerate(index.get(3, ()))]}]


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """documents (path, ord, doc, language, text, root), symbols, occurrences (with doc), external_symbols."""
    schema = to_arrow_schema(StructType.fromDDL(DOCUMENT))

    def work(batches):
        for batch in batches:
            for at, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    rows = decode(memoryview(content.as_buffer()).cast("B"))
                except (IndexError, TypeError, ValueError, AttributeError) as error:
                    raise ValueError(f"{at} is no index: {error}") from error
                for start in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_pylist([r | {"path": at} for r in rows[start : start + 64]], schema)

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, DOCUMENT)
    inner = rows.filter("not external")
    symbol = lambda df: df.select("path", "doc", F.col("ord").alias("doc_ord"), F.inline("symbols"))
    return {
        "documents": inner.drop("symbols", "occurrences", "external"),
        "symbols": symbol(inner),
        "occurrences": inner.select("path", "doc", F.col("ord").alias("doc_ord"), F.inline("occurrences")),
        "external_symbols": symbol(rows.filter("external")).drop("doc", "doc_ord"),
    }


DESCRIPTOR = "struct<scheme: string, package: string, descriptors: array<struct<name: string, suffix: string, disambiguator: string>>>"
SUFFIXES = {"/": "Namespace", "#": "Type", ".": "Term", ":": "Meta", "!": "Macro"}


def _name(text: str, at: int) -> tuple[str, int]:
    if at < len(text) and text[at] == "`":
        out, at = [], at + 1
        while True:
            end = text.index("`", at)
            out.append(text[at:end])
            if text[end + 1 : end + 2] != "`":
                return "".join(out), end + 1
            out.append("`")
            at = end + 2
    end = at
    while end < len(text) and (text[end].isalnum() or text[end] in "_+-$"):
        end += 1
    if end == at:
        raise ValueError("empty name")
    return text[at:end], end


def parse_symbol(symbol: str | None) -> dict | None:
    """scheme, package and descriptors of a global symbol; None for local, empty or malformed ones."""
    if not symbol or symbol.startswith("local "):
        return None
    head, at, part = [], 0, ""
    while len(head) < 4:  # scheme, manager, package, version: ended by one space; two stand for one
        end = symbol.find(" ", at)
        if end < 0:
            return None
        part += symbol[at:end]
        at = end + 1
        if symbol[at : at + 1] == " " and len(part):
            part, at = part + " ", at + 1
            continue
        head.append("" if part == "." else part)
        part = ""
    out = []
    try:
        while at < len(symbol):
            if symbol[at] in "([":
                close, suffix = (")", "Parameter") if symbol[at] == "(" else ("]", "TypeParameter")
                name, at = _name(symbol, at + 1)
                if symbol[at] != close:
                    return None
                out.append({"name": name, "suffix": suffix, "disambiguator": ""})
                at += 1
                continue
            name, at = _name(symbol, at)
            if symbol[at] == "(":
                end = symbol.index(").", at)
                out.append({"name": name, "suffix": "Method", "disambiguator": symbol[at + 1 : end]})
                at = end + 2
            else:
                out.append({"name": name, "suffix": SUFFIXES[symbol[at]], "disambiguator": ""})
                at += 1
    except (IndexError, KeyError, ValueError):
        return None
    return {"scheme": head[0], "package": head[2], "descriptors": out} if out else None


def with_parsed(symbols: DataFrame) -> DataFrame:
    """symbols with the column parsed (null where parse_symbol gives none), an Arrow batch at a time."""
    schema = StructType([*symbols.schema.fields, *StructType.fromDDL(f"parsed {DESCRIPTOR}").fields])
    arrow = to_arrow_schema(schema)

    def work(batches):
        for batch in batches:
            parsed = [parse_symbol(s) for s in batch.column(batch.schema.get_field_index("symbol")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parsed, arrow.field("parsed").type)], schema=pa.schema([*batch.schema, arrow.field("parsed")]))

    return symbols.mapInArrow(work, schema)
