"""Configuration, templates, prompts, sources on disk, languages, and whole runs from the command line."""

import json
import random

import pytest
from pyspark.sql import functions as F

from test_sources import S, TEXT, field, index, occurrence  # noqa: F401
from unitflow.functions import languages, models
from unitflow.functions.templates import TemplateError, compile_template, render
from unitflow.operators import lookups
from unitflow.plans import config, cue, prompts, report
from unitflow.plans.extract import KIND_TAGS, extract
from unitflow.plans.review import Config, Pass, forget, read_cache, review
from unitflow.plans.run import main, merged

BASE = 'package config\n// a comment\nllm: {provider: "openai", base_url: string | *"http://x/v1", model: string | *"small"}\n'


def load(tmp_path, *files, inline=(), env=None):
    paths = []
    for k, text in enumerate(files):
        paths.append(str(tmp_path / f"f{k}.cue"))
        (tmp_path / f"f{k}.cue").write_text(text)
    return config.load(paths, list(inline), env or {})


def test_config_defaults_and_order(tmp_path):
    got = load(tmp_path, BASE + 'pass: zeta: prompt: "builtin:baseline"\npass: "a-b": {\n\tinline_prompt: _text\n\tenabled: false\n}\nlet _text = """\n\tone\n\t  two\n\t"""\n')
    assert got.llm == {"provider": "openai", "base_url": "http://x/v1", "model": "small", "api_key": "", "max_tokens": 32768, "temperature": 0.1}
    assert [(p.name, p.prompt, p.inline_prompt, p.enabled) for p in got.passes] == [("zeta", "builtin:baseline", "", True), ("a-b", "", "one\n  two", False)]
    assert got.output == {"json": "", "markdown": "", "sarif": ""} and got.cache_enabled and got.passes[0].prompt_dir == str(tmp_path)


def test_config_files_and_inline_unify(tmp_path):
    two = 'package config\nllm: model: "large"\nllm: max_tokens: 100\n'
    assert load(tmp_path, BASE, two).llm["model"] == "large" == load(tmp_path, two, BASE).llm["model"]
    assert load(tmp_path, BASE, inline=['llm: { model: "mid", temperature: 1 }']).llm["temperature"] == 1
    assert load(tmp_path, BASE, inline=["llm: api_key: env.MY_KEY"], env={"MY_KEY": "k"}).llm["api_key"] == "k"
    assert load(tmp_path, BASE, inline=["llm: api_key: string | *env.MY_KEY"], env={"MY_KEY": "k"}).llm["api_key"] == "k"
    assert load(tmp_path, BASE, env={config.API_KEY: "e"}).llm["api_key"] == "e"
    for bad in ('llm: model: "a"\nllm: model: "b"', "llm: model: 3", "llm: colour: 1", "else: 1", "llm: api_key: env.NONE", "llm: {", 'llm: model: string | *"other"', 'pass: a: name: "b"'):
        with pytest.raises(ValueError):
            load(tmp_path, BASE, inline=[bad])


def test_config_chooses_passes(tmp_path):
    passes = "\n".join(f'pass: {n}: prompt: "builtin:{n}"' for n in ("summary", "baseline", "security"))
    names = lambda *inline: [p.name for p in load(tmp_path, BASE + passes, BASE, inline=inline).passes]
    assert names() == ["summary", "baseline", "security"]
    assert names("analyse: [pass.security, pass.summary]") == ["security", "summary"] == names('analyse: [pass["security"], pass.summary]')
    assert names("analyse: [for k, v in pass { {v} }]") == ["summary", "baseline", "security"]
    own = load(tmp_path, BASE + 'pass: a: {prompt: "a.txt", llm: {base_url: "u", model: "m"}}').passes[0]
    assert own.llm == {"model": "m", "max_tokens": 32768, "temperature": 0.1}
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "b.cue").write_text('package config\npass: b: prompt: "b.txt"')
    (tmp_path / "deep" / "b.txt").write_text("x")
    (tmp_path / "base.cue").write_text(BASE)
    got = config.load([str(tmp_path / "base.cue"), str(tmp_path / "deep" / "*")], [], {})
    assert [(p.name, p.prompt_dir) for p in got.passes] == [("b", str(tmp_path / "deep"))]
    with pytest.raises(ValueError):
        config.load([str(tmp_path / "none.cue")], [], {})


def test_cue_values():
    def value(text):
        package = cue.Package()
        package.add(text)
        return cue.concrete(package.unified("x"))

    assert value('x: {a: 1, "b c": [1, 2.5, "t\\n\\u00e9"], d: true}') == {"a": 1, "b c": [1, 2.5, "t\né"], "d": True}
    assert value("x: y\ny: *1 | int\nx: int") == 1 and value("x: (*1 | int) & 2") == 2 and value("x: a: b: 1\nx: a: c: 2") == {"a": {"b": 1, "c": 2}}
    assert value("x: int\nx: 1_000") == 1000 and value("x: number\nx: 2") == 2
    for bad in ("x: int", "x: 1 | 2", "x: x", "x: nothing", 'x: "\\(1)"', "x: true\nx: int", "x: [1]\nx: [1, 2]"):
        with pytest.raises(ValueError):
            value(bad)


def test_templates():
    said = lambda text, data=None: render(compile_template(text), data or {})
    data = {"A": "x", "L": ["p", "q"], "E": [], "S": {"N": 1}, "Z": ""}
    assert said("a {{- .A -}}  b {{/* c */}}{{.S.N}}", data) == "axb 1"
    assert said("{{range .L}}<{{.}}{{$.A}}>{{else}}none{{end}}{{range .E}}x{{else}}none{{end}}", data) == "<px><qx>none"
    assert said("{{range $i, $v := .L}}{{$i}}{{$v}} {{end}}{{with .S}}{{.N}}{{end}}{{with .Z}}y{{end}}", data) == "0p 1q 1"
    assert said('{{if and .A .Z}}1{{else if or .Z .A}}2{{end}}{{if not .E}}3{{end}}{{if eq .A "x" "y"}}4{{end}}{{len .L | printf "%d-%d" 5}}', data) == "2345-2"
    assert said('{{define "t"}}[{{.}}]{{end}}{{template "t" .A}}{{block "u" .S}}{{.N}}{{end}}{{$v := .A}}{{$v}}{{index .L 1}}{{.L}}', data) == "[x]1xq[p q]"
    assert said('{{printf "%s/%d/%q" .A .S.N .A}}{{print (len .L)}}{{"a" | print}}', data) == 'x/1/"x"2a'
    for bad in ("{{", "{{if .A}}", "{{end}}", "{{.None}}", '{{template "none"}}', "{{nofunc 1}}", "{{.A.B.C}}", "{{(}}", "{{$x}}", "{{if .A}}{{else}}"):
        with pytest.raises((TemplateError, TypeError)):
            said(bad, data)


CTX = {"language": "Go", "functions": [{"name": "f", "package": "p", "body": "BODY", "doc": "", "signature": "s", "receiver": ""}]}
TOLD = {"purpose": "PURPOSE", "behavior": "", "invariants": ["INV"], "security": []}
FULL = CTX | {"receiver": {"name": "T", "kind": "struct", "body": "TBODY", "doc": "", "signature": "", "summary": TOLD | {"purpose": "TYPED"}, "methods": [{"name": "g", "signature": "", "doc": "```ts\ng(x)\n```\nmore  of\nit"}]}, "summary": TOLD, "callees": [{"unit_id": "p.h", "summary": TOLD | {"purpose": "CALLED"}}], "externals": [{"package": "io", "name": "Read", "signature": "SIG", "doc": "D"}]}


@pytest.mark.parametrize("name, blocks", [("summary", "rce"), ("baseline", "rsi"), ("correctness", "rscei"), ("concurrency", "rscei"), ("security", "rscei"), ("maintainability", "rsi")])
def test_builtin_prompts_have_their_blocks(name, blocks):
    text, bare = (prompts.prompt(prompts.load(f"builtin:{name}"), c) for c in (FULL, CTX))
    marks = {"r": "TYPED", "s": "PURPOSE", "c": "CALLED", "e": "io.Read", "i": "Rate each issue"}
    assert {b for b, m in marks.items() if m in text} == set(blocks) and "BODY" in bare and not any(m in bare for b, m in marks.items() if b != "i")
    assert ("`g(x)`: more of it" in text) == ("r" in blocks)
    group = prompts.prompt(prompts.load(f"builtin:{name}"), CTX | {"functions": [CTX["functions"][0], CTX["functions"][0] | {"name": "k", "body": "SECOND"}]})
    assert "SECOND" in group and "BODY" in group


def test_prompts_load_from_files_folders_and_inline(tmp_path):
    (tmp_path / "own.txt").write_text('{{template "base" .}}{{.Name}}')
    with pytest.raises(TemplateError):
        prompts.prompt(prompts.load(str(tmp_path / "own.txt")), CTX)
    (tmp_path / "_base.txt").write_text('{{define "base"}}B{{end}}')
    (tmp_path / "security.txt").write_text('{{template "base"}}S')
    got = prompts.load_all([Pass("a", inline_prompt='{{template "function-context" .}}!'), Pass("b", "own.txt", prompt_dir=str(tmp_path)), Pass("security"), Pass("off", "", enabled=False)], str(tmp_path))
    assert [prompts.prompt(got[n], CTX) for n in ("a", "b", "security")] == ["\n```\nBODY\n```!", "Bf", "BS"] and set(got) == {"a", "b", "security", "type_summary"}
    for bad in (Pass("x", ""), Pass("x", "builtin:none"), Pass("x", "none.txt"), Pass("x", inline_prompt="{{")):
        with pytest.raises(ValueError, match="x"):
            prompts.load_all([bad])


def test_answers_are_typed():
    with pytest.raises(ValueError, match="purpose"):
        models.decoded('{"purpose": 3}', "summary")
    for bad in ('{"issues": [{"line": "3"}]}', '{"issues": 1}', "[]", '{"issues": []} x', ""):
        with pytest.raises(ValueError):
            models.decoded(bad, "issues")
    assert models.decoded('{"Purpose": "p", "other": 1, "invariants": null}', "summary")["purpose"] == "p"
    assert models.decoded("null", "issues") == {"issues": []} == models.decoded("{}", "issues")


def test_every_kind_has_its_tag(spark, tmp_path):
    numbers = {"Class": 7, "Struct": 49, "Interface": 21, "Trait": 53, "Enum": 11, "Protocol": 42, "Union": 59, "TypeClass": 56, "TypeAlias": 55, "Type": 54}
    doc = field(1, "a.go") + b"".join(field(3, field(1, f"{S}{k}#") + field(5, n)) for k, n in numbers.items())
    (tmp_path / "i.scip").write_bytes(field(2, doc))
    tags = {r["name"]: r["kind"] for r in extract(spark, str(tmp_path / "i.scip")).types.collect()}
    assert tags == {k: k.lower() for k in numbers} | {"TypeAlias": "type"} and set(KIND_TAGS) < set(numbers)


def test_external_symbols_last_counts(spark, tmp_path):
    ext = "scip-x m std v2 io/put()."
    doc = field(1, "a.x") + field(3, field(1, S + "f().") + field(5, 17)) + field(2, occurrence(S + "f().", [0, 0, 1], True)) + field(2, occurrence(ext, [1, 0, 1]))
    (tmp_path / "i.scip").write_bytes(field(2, doc) + field(3, field(1, ext) + field(6, "first")) + field(3, field(1, ext) + field(6, "second")))
    assert [r["name"] for r in extract(spark, str(tmp_path / "i.scip")).externals.collect()] == ["second"]


def test_sources_on_disk_and_root(spark, tmp_path):
    doc = field(1, "src/a b.x") + field(3, field(1, S + "f().") + field(5, 17)) + field(2, occurrence(S + "f().", [1, 0, 1], True, [1, 0, 2, 3]))
    gone = field(1, "src/gone.x") + field(3, field(1, S + "g().") + field(5, 17)) + field(2, occurrence(S + "g().", [0, 0, 1], True, [0, 0, 0, 3]))
    short = field(1, "src/short.x") + field(5, "x") + field(3, field(1, S + "h().") + field(5, 17)) + field(2, occurrence(S + "h().", [0, 0, 1], True, [0, 0, 0, 3]))
    (tmp_path / "i.scip").write_bytes(field(1, field(3, "file:///nowhere")) + field(2, doc) + field(2, gone) + field(2, short))
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a b.x").write_text("zero\none\ntwo\n")
    (tmp_path / "src" / "other.y").write_text("zero")
    bare = extract(spark, str(tmp_path / "i.scip"))
    assert {r["name"]: r["body"] for r in bare.functions.collect()} == {"f": "", "g": "", "h": "x"}
    got = extract(spark, str(tmp_path / "i.scip"), root=str(tmp_path))
    rows = {r["name"]: r for r in got.functions.collect()}
    assert rows["f"]["body"] == "one\ntwo" and rows["f"]["position"]["Filename"] == f"{tmp_path}/src/a b.x" and rows["h"]["body"] == "x"
    assert [r[0] for r in got.warnings.collect()] == [f"failed to read source for {S}g(). at {tmp_path}/src/gone.x"]


def test_languages(spark):
    shown = spark.createDataFrame([("CPP",), ("rust",), ("Zig",), ("objectivecpp",)], "x string").select(languages.display(F.col("x"))).collect()
    assert [r[0] for r in shown] == ["C++", "Rust", "Zig", "Objective-C++"]
    files = [("a", "x.go", "CPP"), ("a", "y.go", "cpp"), ("a", "z.go", "CPP"), ("b", "x.go", ""), ("c", "x.TS", ""), ("c", "y.tsx", ""), ("c", "z.py", ""), ("d", "x", ""), ("e", "q.go", "b"), ("e", "q.go", "a")]
    symbols = [("a", 1, "scip-go"), ("b", 1, "unknown"), ("b", 2, "rust-analyzer"), ("b", 3, "scip-go"), ("c", 1, "unknown")]
    got = languages.pick(spark.createDataFrame(files, "k string, path string, language string"), spark.createDataFrame(symbols, "k string, at int, scheme string"), "k").collect()
    assert {r["k"]: r["language"] for r in got} == {"a": "C++", "b": "Rust", "c": "TypeScript", "e": "a"}


def told(word):
    return json.dumps({"purpose": word, "behavior": "", "invariants": [], "security": []})


def test_review_goes_on_where_it_stopped(spark, index, tmp_path):  # noqa: F811
    ex = extract(spark, index)
    unit, passes = "pkg/a.(Box).get+pkg/a.help", [Pass("summary"), Pass("baseline")]
    answers = {("type_summary", "pkg/a.Box"): told("boxes"), ("summary", unit): told("helps")}
    with pytest.raises(Exception, match="no answer"):
        review(spark, ex, models.KeyedClient(answers | {("baseline", unit): "no answer"}), Config(passes=passes, state=str(tmp_path / "s")))
    mute = models.KeyedClient({("summary", unit): "asked again", ("type_summary", "pkg/a.Box"): "asked again"})
    units, issues = review(spark, ex, mute, Config(passes=passes, state=str(tmp_path / "s")))
    assert [r["purpose"] for r in units.collect()] == ["helps"] and issues.count() == 0
    with pytest.raises(Exception, match="asked again"):
        review(spark, ex, mute, Config(passes=passes))


def test_calls_are_those_of_the_cost_model(spark, index, tmp_path):  # noqa: F811
    """Cold: a call a type and a unit and pass. Warm: none for summaries."""
    ex = extract(spark, index)
    passes = [Pass("summary"), Pass("baseline"), Pass("security")]
    client = models.KeyedClient({}, {"summary": told("t")})
    calls, seen = [], []
    for k in range(2):
        review(spark, ex, client, Config(passes=passes, cache=str(tmp_path / "c"), state=str(tmp_path / f"s{k}"), progress=lambda phase, n: seen.append((phase, n))))
        calls.append((read_cache(spark, str(tmp_path / "c")).count(), spark.read.parquet(str(tmp_path / f"s{k}" / "answers")).count()))
    n_types, n_units = ex.types.count(), ex.units.count()
    assert calls == [(n_types + n_units, 2 * n_units)] * 2 and seen == [("types", n_types), ("level-0", n_units), ("answers", 2 * n_units)] * 2


def test_cache_entries_can_be_deleted(spark, tmp_path):
    cache = str(tmp_path / "c")
    spark.createDataFrame([("a", "1"), ("b", "2")], "cache_key string, payload string").write.parquet(cache)
    forget(spark, cache, spark.createDataFrame([("a",), ("z",)], "cache_key string"))
    assert [tuple(r) for r in read_cache(spark, cache).collect()] == [("b", "2")]


def test_reports_merge(spark):
    unit = lambda u, p: (u, 0, [], p, "", [], [])
    issue = lambda u, m: (u, 0, None, "low", "baseline", m, "", "")
    old = spark.createDataFrame([unit("a", "old"), unit("b", "old")], report.UNITS), spark.createDataFrame([issue("a", "old"), issue("b", "old")], report.ISSUES)
    new = spark.createDataFrame([unit("b", "new"), unit("c", "new")], report.UNITS), spark.createDataFrame([issue("c", "new")], report.ISSUES)
    units, issues = merged(old, new)
    assert sorted((r.unit_id, r.purpose) for r in units.collect()) == [("a", "old"), ("b", "new"), ("c", "new")] and sorted((r.unit_id, r.message) for r in issues.collect()) == [("a", "old"), ("c", "new")]


def test_command_line(spark, index, tmp_path, capsys):  # noqa: F811
    out = {k: str(tmp_path / f"r.{k}") for k in ("json", "markdown", "sarif")}
    (tmp_path / "c.cue").write_text(BASE + f'cache: dir: "{tmp_path}/cache"\noutput: {json.dumps(out)}\npass: summary: prompt: "builtin:summary"\npass: own: inline_prompt: "check {{{{.Language}}}}"\n')
    issue = {"issues": [{"function": "help", "line": 0, "code": "get()", "severity": "critical", "message": "loops"}]}
    unit = "pkg/a.(Box).get+pkg/a.help"
    args = ["run", "-config", str(tmp_path / "c.cue"), "-scip", index, "src/*"]
    assert main(args, models.KeyedClient({("summary", unit): told("helps"), ("own", unit): json.dumps(issue)})) == 0
    made = json.loads((tmp_path / "r.json").read_text())
    assert made["units"][unit]["summary"]["purpose"] == "helps" and made["summary"]["critical_units"] == [unit] and made["metadata"]["modules"] == ["src/*"]
    assert "CRITICAL" in (tmp_path / "r.markdown").read_text() and "loops" in (tmp_path / "r.sarif").read_text() and "1 issues found" in capsys.readouterr().out
    assert main([*args[:1], "-resume", *args[1:]], models.KeyedClient()) == 0
    assert json.loads((tmp_path / "r.json").read_text())["units"] == made["units"]
    assert main(["run", "-config", str(tmp_path / "none.cue"), "-scip", index]) == 1


def test_lookups(spark):
    r = random.Random(2)
    rows = [(r.randrange(5), k, f"v{r.randrange(9)}") for k in range(60)]
    df = spark.createDataFrame(rows, "k long, o long, v string").repartition(5)
    by = {k: [v for x, _, v in rows if x == k] for k, _, _ in rows}
    assert {x.k: x.all for x in lookups.listed(df, "k", ["o"], "v", "all").collect()} == by
    assert {x.k: x.v for x in lookups.last_of(df, ["k"], ["o"], ["v"]).collect()} == {k: v[-1] for k, v in by.items()}
    assert {x.k: x.v for x in lookups.first_of(df, ["k"], ["o"], ["v"]).collect()} == {k: v[0] for k, v in by.items()}
    assert [(x.o, x.place) for x in lookups.placed(df, ["v", "o"]).orderBy("place").collect()] == [(o, n + 1) for n, (_, o, _) in enumerate(sorted(rows, key=lambda x: (x[2], x[1])))]
    members = spark.createDataFrame([("t", "a", 1), ("t", "b", 2), ("t", "c", 3), ("u", "d", 1)], "owner string, fn string, at int")
    units = spark.createDataFrame([("x", "t", "a"), ("x", "t", "b"), ("y", "t", "c"), ("z", "u", "d")], "unit string, owner string, fn string")
    assert sorted((x.unit, x.fn) for x in lookups.siblings(members, "owner", "fn", units, "unit").collect()) == [("x", "c"), ("y", "a"), ("y", "b")]


def test_packages_from_tables(spark):
    from unitflow.plans.packages import from_tables

    place = "struct<Filename: string, Offset: long, Line: long, Column: long>"
    functions = spark.createDataFrame([(0, "p", "Get", "*Box[T]", "get", "B0", "", None), (1, "p", "Put", "Box[T]", "put", "B1", "", None), (2, "p", "help", "", "help", "B2", "", None), (3, "p", "help", "", "help2", "B3", "", None), (4, "q", "x", "*None", "x", "", "", None)], f"ord int, package string, name string, receiver string, signature string, body string, doc string, position {place}")
    types = spark.createDataFrame([(0, "p", "Box", "struct", "s", "T", "", None)], f"ord int, package string, name string, kind string, signature string, body string, doc string, position {place}")
    calls = spark.createDataFrame([("p.(*Box[T]).Get", "p.help", 2), ("p.(*Box[T]).Get", "io.Read", 1), ("p.help", "io.(*R).Close", 1), ("p.help", "os.Exit", 2), ("p.help", "far.Away", 3)], "caller string, callee string, ord long")
    symbols = spark.createDataFrame([("io", "Read", "", "read", "d"), ("io", "Close", "*R", "close", None), ("os", "Exit", "", "", ""), ("far", "Away", "", "away", "")], "package string, name string, receiver string, signature string, doc string")
    imports = spark.createDataFrame([("p", "io"), ("io", "os")], "package string, import string")
    got = from_tables(functions, types, calls, symbols, imports)
    rows = {r["fn_id"]: r for r in got.functions.collect()}
    assert rows["p.help"]["body"] == "B3" and {k: v["receiver_type"] for k, v in rows.items()} == {"p.(*Box[T]).Get": "p.Box", "p.(Box[T]).Put": "p.Box", "p.help": "", "q.(*None).x": ""}
    assert [(r["type_id"], r["methods"]) for r in got.types.collect()] == [("p.Box", ["p.(*Box[T]).Get", "p.(Box[T]).Put"])]
    assert sorted((r["ext_id"], r["name"], r["signature"], r["doc"]) for r in got.externals.collect()) == [("io.(*R).Close", "Close", "close", ""), ("io.Read", "Read", "read", "d")]
    assert {r["unit_id"]: (r["callees"], r["externals"]) for r in got.units.collect()}["p.(*Box[T]).Get"] == (["p.help"], ["io.Read"])


@pytest.mark.parametrize("group, names", [("core", ["baseline", "correctness", "security", "summary"]), ("concurrency", ["concurrency"]), ("architecture", ["domain-types", "functional-core", "layout", "maintainability"]), ("web", ["authorization", "context-propagation", "distributed", "http", "observability"]), ("testing", ["testing"])])
def test_example_passes_load(tmp_path, group, names):
    from pathlib import Path

    (tmp_path / "base.cue").write_text(BASE)
    got = config.load([str(tmp_path / "base.cue"), str(Path(__file__).resolve().parents[1] / "examples" / group / "*")], [], {})
    assert [p.name for p in got.passes] == names
    templates = prompts.load_all(got.passes)
    assert all("BODY" in prompts.prompt(templates[n], FULL) for n in names)


def test_http_client():
    """Requests as sent, and every kind of answer, from a server of this test."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen, answers = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, self.headers.get("Authorization"), json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            status, body = answers.pop(0)
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = models.HttpClient(f"http://127.0.0.1:{server.server_port}/v1", "key")
    request = {"model": "m", "prompt": "p", "max_tokens": 5, "temperature": 0.1, "schema": models.ISSUES}
    answers += [(200, {"choices": [{"message": {"content": "{}"}}]}), (200, {"error": {"message": "busy"}}), (200, {"choices": []}), (500, {})]
    assert client.complete(request) == "{}"
    for wrong in ("busy", "no choices", "500"):
        with pytest.raises(Exception, match=wrong):
            client.complete(request)
    path, rights, body = seen[0]
    assert (path, rights, body["messages"], body["max_tokens"]) == ("/v1/chat/completions", "Bearer key", [{"role": "user", "content": "p"}], 5)
    assert body["response_format"]["json_schema"]["strict"] and body["response_format"]["json_schema"]["schema"]["required"] == ["issues"]
    server.shutdown()


def test_title_case():
    assert [report.title_case(x) for x in ("high", "", "héllo wörld", "ABC")] == ["High", "", "Héllo wörld", "ABC"]
