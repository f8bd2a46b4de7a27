"""Go source as tables: functions, types, imports and calls, one file at a time.

A scanner for the outer structure of files: it knows comments, strings and brackets, not types. So calls are resolved by name: in
the package, through the file's imports, through the method's own receiver, else to every method of that name, which holds
more edges than a typed graph would. Files are read by Spark; test files, and files of folders that begin with _ or . or are
named testdata, are left out. Packages under vendor are symbols of other packages, not code to review.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

TOKEN = re.compile(r"(?P<note>//[^\n]*|/\*.*?\*/)|(?P<text>`[^`]*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)+')|(?P<name>[^\W\d]\w*)|(?P<end>\n)|(?P<space>[ \t\r]+)|(?P<sign>.)", re.S)
OPEN, CLOSE = "([{", ")]}"
PLACE = "line: int, offset: long, column: int"
FUNCTION = f"struct<ord: int, name: string, receiver: string, variable: string, signature: string, body: string, doc: string, {PLACE}>"
TYPE = f"struct<ord: int, name: string, kind: string, signature: string, body: string, doc: string, {PLACE}>"
CALL = "struct<of: int, ord: int, qualifier: string, name: string>"
FILE = f"path string, name string, functions array<{FUNCTION}>, types array<{TYPE}>, imports array<struct<alias: string, path: string>>, calls array<{CALL}>"
KEYWORDS = {"func", "if", "for", "switch", "select", "return", "go", "defer", "range", "case", "map", "chan", "struct", "interface", "type", "var", "const", "else"}


class Scanner:
    def __init__(self, text: str):
        self.text = text
        self.tokens = [(m.lastgroup, m[0], m.start()) for m in TOKEN.finditer(text) if m.lastgroup != "space"]
        self.at = 0

    def skip(self, notes: bool = True) -> None:
        while self.at < len(self.tokens) and self.tokens[self.at][0] in (("end", "note") if notes else ("end",)):
            self.at += 1

    def peek(self) -> tuple[str, str, int]:
        k = self.at
        while k < len(self.tokens) and self.tokens[k][0] == "note" and "\n" not in self.tokens[k][1]:
            k += 1
        return self.tokens[k] if k < len(self.tokens) else ("end", "", len(self.text))

    def take(self) -> tuple[str, str, int]:
        token = self.peek()
        while self.at < len(self.tokens) and self.tokens[self.at][2] < token[2]:
            self.at += 1
        self.at += 1
        return token

    def group(self) -> tuple[int, int]:
        """Passes what an opening bracket, the next token, encloses; where it starts and ends."""
        start, depth = self.peek()[2], 0
        while self.at < len(self.tokens):
            kind, text, place = self.tokens[self.at]
            self.at += 1
            if kind == "sign":
                depth += (text in OPEN) - (text in CLOSE)
                if not depth:
                    return start, place + 1
        return start, len(self.text)

    def rest(self, stop: str = "") -> int:
        """Passes a declaration up to the line's end or stop, outside of brackets; where it ends."""
        end = self.peek()[2]
        while self.at < len(self.tokens):
            kind, text, place = self.tokens[self.at]
            if kind == "end" or (kind == "sign" and (text == ";" or (stop and text in stop))):
                break
            if kind == "sign" and text in OPEN:
                end = self.group()[1]
                continue
            end = place + len(text) if kind != "note" else end
            self.at += 1
        return end


def doc_text(notes: list[str]) -> str:
    """The words of a group of comments: without marks and directives, blank lines once."""
    lines = []
    for note in notes:
        if note.startswith("/*"):
            lines += note[2:-2].split("\n")
        elif not re.match(r"//(?:line |extern |export |[a-z0-9]+:[a-z0-9])", note):
            lines.append(note[2:].removeprefix(" "))
    out: list[str] = []
    for line in map(str.rstrip, lines):
        if line or (out and out[-1]):
            out.append(line)
    text = "\n".join(out).strip("\n")
    return text + "\n" if text else ""


def _flat(text: str) -> str:
    return re.sub(r"\s*\n\s*", " ", text.strip())


def parse(text: str) -> dict:
    """The package's name, functions, types, imports and calls of one file."""
    s = Scanner(text)
    out: dict = {"name": "", "functions": [], "types": [], "imports": [], "calls": []}
    notes: list[tuple[str, int]] = []  # the comments right above

    def place(start: int) -> dict:
        before = text[:start]
        return {"line": before.count("\n") + 1, "offset": len(before.encode()), "column": len(before[before.rfind("\n") + 1 :].encode()) + 1}

    def above(start: int) -> tuple[int, str]:
        """Where the declaration at start begins with its comments, and their text."""
        kept, below = [], start
        for note, at in reversed(notes):
            if text[at + len(note) : below].count("\n") > 1 or text[at + len(note) : below].strip():
                break
            kept.insert(0, note)
            below = at
        return below, doc_text(kept)

    def function(start: int) -> None:
        receiver = variable = ""
        if s.peek()[1] == "(":
            a, b = s.group()
            words = _flat(text[a + 1 : b - 1]).rstrip(",")
            m = re.match(r"([^\W\d]\w*)\s+(\S.*)$", words, re.S)
            variable, receiver = (m[1], m[2]) if m else ("", words)
        name = s.take()[1]
        head = s.peek()[2]
        if s.peek()[1] == "[":
            s.group()
            head = s.peek()[2]
        params, end = s.group()
        results = end
        while s.peek()[0] != "end" and s.peek()[1] != "{":
            word = s.peek()[1]
            if word in OPEN:
                results = s.group()[1]
                continue
            kind, word, at = s.take()
            results = at + len(word)
            if word in ("struct", "interface") and s.peek()[1] == "{":
                results = s.group()[1]
        told = _flat(text[end:results])
        if told.startswith("(") and told.endswith(")") and not re.search(r"[,\s]", told[1:-1]):
            told = told[1:-1]
        first, stop = s.at, results
        if s.peek()[1] == "{":
            stop = s.group()[1]
        begin, doc = above(start)
        signature = "func " + (f"({receiver}) " if receiver else "") + name + _flat(text[params:end]) + (f" {told}" if told else "")
        place_of = len(out["functions"])
        out["functions"].append({"ord": place_of, "name": name, "receiver": receiver, "variable": variable, "signature": signature, "body": text[begin:stop], "doc": doc, **place(begin)})
        called(s.tokens[first : s.at], place_of)

    def called(tokens: list, of: int) -> None:
        words = [t for t in tokens if t[0] not in ("note", "end")]
        for k, (kind, word, _) in enumerate(words):
            if kind != "name" or word in KEYWORDS or k + 1 == len(words) or words[k + 1][1] != "(":
                continue
            if k and words[k - 1][1] == ".":
                qualifier = words[k - 2][1] if k > 1 and words[k - 2][0] == "name" and not (k > 2 and words[k - 3][1] == ".") else "."
            elif k and words[k - 1][1] == "func":
                continue
            else:
                qualifier = ""
            out["calls"].append({"of": of, "ord": len(out["calls"]), "qualifier": qualifier, "name": word})

    def type_spec(start: int) -> None:
        name = s.take()[1]
        signature, head = f"type {name}", s.peek()[2]
        if s.peek()[1] == "[" and re.match(r"\[\s*[^\W\d]\w*\s+[^\]\s]|\[\s*[^\W\d]\w*\s*,", text[head:]):
            a, b = s.group()
            signature += _flat(text[a:b])
        if s.peek()[1] == "=":
            s.take()
        word, a = s.peek()[1], s.peek()[2]
        end = s.rest(")")
        begin, doc = above(start)
        kind = word if word in ("struct", "interface") else "type"
        signature += f" {kind}" if kind != "type" else f" {_flat(text[a:end])}"
        out["types"].append({"ord": len(out["types"]), "name": name, "kind": kind, "signature": signature, "body": text[begin:end], "doc": doc, **place(begin)})

    def specs(one) -> None:
        """A declaration's single part, or those in its parentheses."""
        if s.peek()[1] != "(":
            one(None)
            return
        s.take()
        while s.at < len(s.tokens):
            notes.clear()
            s.skip(False)
            while s.at < len(s.tokens) and s.tokens[s.at][0] in ("note", "end"):
                if s.tokens[s.at][0] == "note":
                    notes.append((s.tokens[s.at][1], s.tokens[s.at][2]))
                s.at += 1
            if s.peek()[1] == ")":
                s.take()
                return
            before = s.at
            one(s.peek()[2])
            if s.peek()[1] == ";":
                s.take()
            s.at += s.at == before

    def imported(_) -> None:
        alias = s.take()[1] if s.peek()[0] == "name" or s.peek()[1] in ("_", ".") else ""
        if s.peek()[0] == "text":
            path = s.take()[1][1:-1]
            last = re.sub(r"/v\d+$", "", path).rpartition("/")[2]
            out["imports"].append({"alias": alias or last, "path": path})
        s.rest(")")

    while s.at < len(s.tokens):
        kind, word, at = s.tokens[s.at]
        s.at += 1
        if kind == "note":
            notes.append((word, at))
        elif kind == "end" or (kind == "sign" and word == ";"):
            continue
        else:
            if word == "package":
                out["name"] = s.take()[1]
            elif word == "import":
                specs(imported)
            elif word == "func":
                function(at)
            elif word == "type":
                single = s.peek()[1] != "("
                specs(lambda inner: type_spec(at if single else inner))
            else:
                s.at -= 1
                s.rest()
            notes.clear()
    return out


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """A row a Go file under root: path (relative), name of its package, functions, types, imports, calls."""
    schema = to_arrow_schema(StructType.fromDDL(FILE))

    def work(batches):
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_pylist([{"path": path, **parse(text or "")}], schema)

    from unitflow.plans.extract import _plain_path

    folder = root.rstrip("/") or "/"
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.go")
    base = spark._jvm.org.apache.hadoop.fs.Path(folder)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/") + "/"
    path = _plain_path(F.col("_metadata.file_path"))
    files = files.select(F.substring(path, F.lit(len(base) + 1), F.length(path)).alias("path"), "value")
    kept = ~F.col("path").rlike(r"_test\.go$|(^|/)([_.][^/]*|testdata)/|(^|/)[_.][^/]*$")
    return files.filter(kept).mapInArrow(work, FILE)


def module_of(spark: SparkSession, root: str) -> str:
    """The module that go.mod under root names; empty without one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/go.mod")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return ""
    rows = spark.read.text(f"{root.rstrip('/')}/go.mod").filter("value rlike '^module[ \\t]'").collect()
    return rows[0][0].split()[1].strip('"') if rows else ""


def chosen(folder: Column, patterns: list[str]) -> Column:
    """Whether a package's folder (relative, empty for the root) is meant by a pattern: ./..., ./a/..., ./a."""
    out = F.lit(False)
    for p in patterns or ["./..."]:
        plain = p.removeprefix("./").rstrip("/")
        plain = "" if plain == "." else plain
        if plain == "..." or plain.endswith("/..."):
            inside = plain.removesuffix("...").rstrip("/")
            out = out | (folder == inside) | folder.startswith(f"{inside}/") if inside else F.lit(True)
        else:
            out = out | (folder == plain)
    return out


def go_tables(spark: SparkSession, root: str, patterns: list[str] | None = None) -> dict[str, DataFrame]:
    """functions, types, calls, symbols and imports, as unitflow.plans.packages takes them."""
    from unitflow.functions.tables import written

    module = module_of(spark, root)
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    files = read_files(spark, root).withColumn("folder", folder)
    vendored = F.regexp_extract("folder", "(?:^|/)vendor/(.+)$", 1)
    own = F.when(F.col("folder") == "", F.lit(module or ".")).otherwise(F.concat(F.lit(f"{module}/" if module else ""), "folder"))
    files = written(files.withColumn("vendored", vendored).withColumn("package", F.when(vendored != "", vendored).otherwise(own)))
    position = F.struct(F.concat(F.lit(f"{root.rstrip('/')}/"), "path").alias("Filename"), F.col("x.offset").alias("Offset"), F.col("x.line").cast("long").alias("Line"), F.col("x.column").cast("long").alias("Column")).alias("position")
    inside = files.filter((F.col("vendored") == "") & chosen(F.col("folder"), patterns or []))
    order = F.struct("path", "x.ord").alias("ord")
    functions = written(inside.select("path", "package", F.explode("functions").alias("x")).select(order, "path", "package", F.col("x.ord").alias("of"), "x.name", "x.receiver", "x.variable", "x.signature", "x.body", "x.doc", position))
    types = inside.select("path", "package", F.explode("types").alias("x")).select(order, "package", "x.name", "x.kind", "x.signature", "x.body", "x.doc", position)
    imports = files.select("path", "package", F.explode("imports").alias("x")).select("path", "package", "x.alias", F.col("x.path").alias("import"))
    every = files.select("package", F.explode("functions").alias("x")).select("package", "x.name", "x.receiver", "x.signature", "x.doc")

    from unitflow.functions import text as T

    ids = functions.withColumn("fn_id", T.function_id(F.col("package"), F.col("name"), F.col("receiver"), F.lit(""))).withColumn("bare", T.strip_pointer(F.col("receiver")))
    calls = inside.select("path", F.explode("calls").alias("x")).select("path", "x.of", F.col("x.ord").alias("at"), "x.qualifier", F.col("x.name").alias("called"))
    calls = written(calls.join(ids.select("path", "of", "package", "variable", F.col("bare").alias("own"), F.col("fn_id").alias("caller")), ["path", "of"]))
    known = lambda *cols: ids.select(*cols, F.col("name").alias("called"), F.col("fn_id").alias("callee"))
    plain = calls.filter("qualifier = ''").join(known("package", "bare").filter("bare = ''").drop("bare"), ["package", "called"])
    through = imports.select("path", F.col("alias").alias("qualifier"), "import").distinct()
    foreign = calls.filter("qualifier <> ''").join(through, ["path", "qualifier"]).withColumn("callee", F.concat("import", F.lit("."), "called"))
    others = calls.filter("qualifier <> ''").join(through, ["path", "qualifier"], "left_anti")
    mine = (F.col("qualifier") == F.col("variable")) & (F.col("own") != "")
    owned = known("package", F.col("bare").alias("own")).filter("own <> ''").withColumn("owned", F.lit(True))
    by_own = others.filter(mine).join(owned, ["package", "own", "called"], "left")
    free = others.filter(~mine).unionByName(by_own.filter("owned is null").select(*others.columns))
    any_of = free.join(known("bare").filter("bare <> ''").drop("bare"), "called")
    found = [x.select("caller", "callee", F.col("at").cast("long").alias("ord")) for x in (plain, foreign, by_own.filter("owned"), any_of)]
    edges = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3]).groupBy("caller", "callee").agg(F.min("ord").alias("ord"))
    return {"functions": functions.drop("path", "of", "variable"), "types": types, "calls": edges, "symbols": every, "imports": imports.select("package", "import").distinct()}
