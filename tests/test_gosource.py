"""Go source: files as parsed, packages as read, calls as resolved."""

from unitflow.functions import models
from unitflow.plans.packages import extract_go
from unitflow.plans.run import main
from unitflow.sources.gosource import doc_text, parse

SOURCE = '''// Package note.
package store

import "fmt"
import (
	str "strings" // why
	"example.org/far/v2"
)

var table = map[string]func(int) int{"a": func(x int) int { return one(x) }}

// Store keeps things.
//
//go:generate something
// It is shared.
type Store[K comparable, V any] struct {
	items map[K]V // { not a brace
}

type (
	// ID names one.
	ID = string
	Lister interface {
		List(from int) ([]string, error)
	}
	pair [2]int
)

/* Put stores a value. */
func (s *Store[K, V]) Put(key K,
	value V) (err error) {
	text := "} not an end" + `{ nor
 this`
	s.check(key); fmt.Println(text, '}', str.ToUpper("x"))
	return far.Send(func() { one(1) }())
}

func (Store[K, V]) check(key K) {}

func one(x int) interface{ Do() } { return two(x).Do() }

func two(x int) (Lister)  {
	return nil
}

func outside(a, b int) (int, error)
'''


def test_parse():
    got = parse(SOURCE)
    assert got["name"] == "store" and [(i["alias"], i["path"]) for i in got["imports"]] == [("fmt", "fmt"), ("str", "strings"), ("far", "example.org/far/v2")]
    f = {x["name"]: x for x in got["functions"]}
    assert list(f) == ["Put", "check", "one", "two", "outside"]
    assert (f["Put"]["receiver"], f["Put"]["variable"], f["check"]["receiver"], f["check"]["variable"]) == ("*Store[K, V]", "s", "Store[K, V]", "")
    assert f["Put"]["signature"] == "func (*Store[K, V]) Put(key K, value V) (err error)" and f["two"]["signature"] == "func two(x int) Lister"
    assert f["one"]["signature"] == "func one(x int) interface{ Do() }" and f["outside"]["signature"] == "func outside(a, b int) (int, error)"
    assert f["Put"]["body"].startswith("/* Put stores a value. */\nfunc (s") and f["Put"]["body"].endswith("}())\n}") and f["Put"]["doc"] == " Put stores a value.\n"
    assert f["two"]["body"] == "func two(x int) (Lister)  {\n\treturn nil\n}" and f["Put"]["line"] == SOURCE[: SOURCE.index("/* Put")].count("\n") + 1
    t = {x["name"]: x for x in got["types"]}
    assert {k: (x["kind"], x["signature"]) for k, x in t.items()} == {"Store": ("struct", "type Store[K comparable, V any] struct"), "ID": ("type", "type ID string"), "Lister": ("interface", "type Lister interface"), "pair": ("type", "type pair [2]int")}
    assert t["Store"]["doc"] == "Store keeps things.\n\nIt is shared.\n" and t["ID"]["doc"] == "ID names one.\n" and t["ID"]["body"] == "// ID names one.\n\tID = string" and t["Lister"]["doc"] == ""
    assert t["Store"]["body"].startswith("// Store keeps") and t["Store"]["body"].endswith("brace\n}") and t["Lister"]["body"].startswith("Lister interface {")
    calls = [(got["functions"][c["of"]]["name"], c["qualifier"], c["name"]) for c in got["calls"]]
    assert calls == [("Put", "s", "check"), ("Put", "fmt", "Println"), ("Put", "str", "ToUpper"), ("Put", "far", "Send"), ("Put", "", "one"), ("one", "", "two"), ("one", ".", "Do")]


def test_odd_files():
    for text in ("", "package", "func", "type (", "func (", "import (", "package a\nfunc f() {", "}{)(", "type x", "/* open", "var x = `"):
        parse(text)
    assert doc_text(["// a", "//", "//", "// b", "//go:build x"]) == "a\n\nb\n" and doc_text(["/* x\ny */"]) == " x\ny\n"


def test_packages_are_read(spark, tmp_path, capsys):
    files = {
        "go.mod": "module example.org/app\n\ngo 1.22\n",
        "main.go": 'package main\n\nimport "example.org/app/store"\nimport "example.org/far"\n\nfunc main() { run(); store.Open().Close(); far.Send() }\n\nfunc run() { main() }\n',
        "store/store.go": "package store\n\n// Box holds.\ntype Box struct{}\n\nfunc Open() *Box { return nil }\n\nfunc (b *Box) Close() { b.flush() }\n\nfunc (b *Box) flush() {}\n",
        "other/o.go": "package other\n\ntype T int\n\nfunc (T) flush() {}\n",
        "vendor/example.org/far/far.go": "package far\n\n// Send sends.\nfunc Send() {}\n",
        "store/store_test.go": "package store\n\nfunc TestX() {}\n",
        "testdata/x.go": "package x\n\nfunc X() {}\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = extract_go(spark, str(tmp_path))
    box = "example.org/app/store.(*Box)"
    assert sorted(r["fn_id"] for r in got.functions.collect()) == ["example.org/app.main", "example.org/app.run", "example.org/app/other.(T).flush", f"{box}.Close", f"{box}.flush", "example.org/app/store.Open"]
    edges = {(r["caller"].rpartition("/")[2], r["callee"].rpartition("/")[2]) for r in got.edges.collect()}
    assert edges == {("app.main", "app.run"), ("app.run", "app.main"), ("app.main", "store.Open"), ("app.main", "store.(*Box).Close"), ("app.main", "far.Send"), ("store.(*Box).Close", "store.(*Box).flush")}
    units = {r["unit_id"]: (r["callees"], r["externals"]) for r in got.units.collect()}
    assert units["example.org/app.main+example.org/app.run"] == (["example.org/app/store.Open", f"{box}.Close"], ["example.org/far.Send"])
    assert [(r["ext_id"], r["signature"], r["doc"]) for r in got.externals.collect()] == [("example.org/far.Send", "func Send()", "Send sends.\n")]
    assert {r["type_id"]: r["methods"] for r in got.types.collect()} == {"example.org/app/store.Box": [f"{box}.Close", f"{box}.flush"], "example.org/app/other.T": ["example.org/app/other.(T).flush"]}
    only = extract_go(spark, str(tmp_path), ["./store/..."]).functions.collect()
    assert len(only) == 3 and {r["position"]["Filename"] for r in only} == {f"{tmp_path}/store/store.go"}
    (tmp_path / "c.cue").write_text(f'package config\nllm: {{base_url: "u", model: "m"}}\ncache: enabled: false\noutput: json: "{tmp_path}/r.json"\npass: summary: prompt: "builtin:summary"\n')
    told = '{"purpose": "p", "behavior": "", "invariants": [], "security": []}'
    assert main(["run", "-config", str(tmp_path / "c.cue"), "-root", str(tmp_path), "./store"], models.KeyedClient({}, {"summary": told})) == 0
    assert "Created 3 analysis units" in capsys.readouterr().out
