"""Graph, range and text operators against small cases and naive versions."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from unitflow.functions import tables
from unitflow.functions import text as T
from unitflow.functions.tables import written
from unitflow.operators import graph, hierarchy, joins, lookups, ranges


def naive_reach(names, edges):
    reach = {a: {a} for a in names}
    for _ in names:
        for a in names:
            reach[a] |= {c for b in list(reach[a]) for x, c in edges if x == b}
    return reach


def naive_units(names, edges):
    """scc of every name, and the level of every scc."""
    reach = naive_reach(names, edges)
    scc = {a: min(b for b in names if b in reach[a] and a in reach[b]) for a in names}
    level = dict.fromkeys(scc.values(), 0)
    for _ in level:
        for a, b in edges:
            if scc[a] != scc[b]:
                level[scc[a]] = max(level[scc[a]], level[scc[b]] + 1)
    return scc, level


def call_tables(spark, names, edges):
    return spark.createDataFrame([(a,) for a in names], "fn_id string"), spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(edges)], "caller string, callee string, ord long")


@pytest.mark.parametrize("seed", [0, 3])
def test_components_and_their_order_on_random_graphs(spark, seed):
    """Sparse graphs, with chains and rings through them: whatever contraction takes out must come back right."""
    r = random.Random(seed)
    names = [f"n{i:02}" for i in range(r.randrange(12, 34))]
    edges = {(r.choice(names), r.choice(names)) for _ in range(len(names) * (2 + seed) // 3)}
    for _ in range(3):
        walk = [r.choice(names) for _ in range(r.randrange(3, 8))]
        edges |= set(zip(walk, walk[1:])) | ({(walk[-1], walk[0])} if seed % 2 else set())
    scc, level = naive_units(names, sorted(edges))
    nodes, table = call_tables(spark, names, sorted(edges))
    members = written(graph.components(nodes, table.unionByName(table)))
    assert {r.fn_id: r.scc for r in members.collect()} == scc
    place = {s: k for k, s in enumerate(sorted(level, key=lambda s: (level[s], s)))}
    assert {r.fn_id: r.ordinal for r in graph.ordered(members, table).collect()} == {a: place[scc[a]] for a in names}


def test_components_without_edges_or_nodes(spark):
    nodes, edges = call_tables(spark, ["a", "b"], [("a", "a"), ("a", "x"), ("x", "b")])
    assert sorted(map(tuple, graph.components(nodes, edges).collect())) == [("a", "a"), ("b", "b")]
    assert graph.components(nodes.limit(0), edges).collect() == []


def count_tables(monkeypatch):
    made = []

    def counted(df):
        made.append(1)
        return written(df)

    monkeypatch.setattr(graph, "written", counted)
    return made


def test_deep_graphs_take_few_rounds(spark, monkeypatch):
    made = count_tables(monkeypatch)
    name = lambda c: F.format_string("n%07d", c)
    n = 100_000
    nodes = spark.range(n).select(name(F.col("id")).alias("fn_id"))
    chain = spark.range(n - 1).select(name(F.col("id")).alias("caller"), name(F.col("id") + 1).alias("callee"))
    assert graph.components(nodes, chain).filter("fn_id <> scc").isEmpty() and len(made) < 40
    del made[:]
    ring = chain.unionByName(spark.range(1).select(name(F.lit(n - 1)).alias("caller"), name(F.lit(0)).alias("callee")))
    assert graph.components(nodes, ring).filter("scc = 'n0000000'").count() == n and len(made) < 40
    del made[:]
    # every node calls the next one and the last one
    last = spark.range(n - 2).select(name(F.col("id")).alias("caller"), name(F.lit(n - 1)).alias("callee"))
    found = graph.unit_levels(nodes.withColumnRenamed("fn_id", "unit_id"), chain.unionByName(last).withColumnRenamed("caller", "unit_id"))
    assert found.filter(F.col("level") + F.substring("unit_id", 2, 9).cast("int") != n - 1).isEmpty() and len(made) < 60


def test_labels_jump_ahead(spark, monkeypatch):
    """A ladder has no chains; the least label still crosses it in fewer rounds than it has rungs."""
    made = count_tables(monkeypatch)
    n = 400
    rungs = spark.range(n)
    left, right = F.col("id") * 2, F.col("id") * 2 + 1
    pairs = [(left, left + 2), (right, right + 2), (left, right), (right, left)]
    edges = None
    for a, b in pairs:
        some = rungs.select(a.alias("a"), b.alias("b"))
        edges = some if edges is None else edges.unionByName(some)
    assert graph.spread(edges).filter("label > 1").isEmpty() and len(made) < 60


def test_positions_and_ordered_calls_against_naive(spark):
    """One unit calls nearly all others: its callees are numbered over many range partitions, in first-seen order."""
    r = random.Random(12)
    names = ["hub", "hub2", *(f"n{k:04}" for k in range(1500))]
    edges = [("hub", n, k) for k, n in enumerate(r.sample(names[2:], 1400))] + [("hub2", "hub", 5), ("hub", "hub2", 2000), ("hub2", "n0001", 0), ("n0003", "n0002", 0), ("n0003", "n0001", 7)]
    scc = {n: "hub" if n == "hub2" else n for n in names}
    title = {n: "hub+hub2" if scc[n] == "hub" else n for n in names}
    want = {}
    for a, b, k in sorted(edges, key=lambda e: (e[0], e[2])):
        if scc[a] != scc[b] and title[b] not in want.setdefault(title[a], []):
            want[title[a]].append(title[b])
    members = spark.createDataFrame(list(scc.items()), "fn_id string, scc string")
    got = graph.ordered_calls(members, spark.createDataFrame(edges, "caller string, callee string, ord long")).collect()
    assert sorted((x.unit_id, x.ord, x.callee) for x in got) == sorted((u, k, c) for u, cs in want.items() for k, c in enumerate(cs))
    rows = spark.range(30_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("k"), (F.col("id") * 7919 % 30_011).alias("o"))
    found = lookups.positions(rows, ["k"], ["o"])
    assert found.filter("k = -1").agg(F.min("ord"), F.max("ord"), F.countDistinct("ord")).first()[:] == (0, 26_999, 27_000)
    assert found.filter("k <> -1 and ord <> 0").isEmpty()
    assert found.filter("k = -1").alias("a").join(found.filter("k = -1").select(F.col("ord") - 1, F.col("o").alias("next")).toDF("ord", "next"), "ord").filter("next <= o").isEmpty()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_join_is_a_join(spark, how):
    r = random.Random(9)
    left = spark.createDataFrame([(r.choice(["hot"] * 30 + ["a", "b", None]), k % 40) for k in range(900)], "k string, v int")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("a", 3), (None, 4)], "k string, w int")
    want = sorted(map(str, left.join(right, ["k"], how).collect()))
    assert sorted(map(str, joins.split_join(left, right, ["k"], how, most=50).collect())) == want
    assert joins.hot_keys(left, ["k"], most=900) is None


def test_split_join_deals_a_hot_key_over_many_tasks(spark):
    """One symbol in nine of ten rows: no task may take more than a few times what the middle one takes."""
    left = spark.range(200_000).select(F.when(F.col("id") % 10 < 9, "print").otherwise(F.concat(F.lit("s"), (F.col("id") % 5000).cast("string"))).alias("symbol"), "id")
    right = left.select("symbol").distinct().withColumn("target", F.length("symbol"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(old, ("64", "false", "-1")):
            spark.conf.set(k, v)
        tasks = [x["n"] for x in joins.split_join(left, right, ["symbol"], most=1000).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(tasks) == 200_000 and max(tasks) < 4 * sorted(tasks)[len(tasks) // 2]


def test_method_sets_against_naive(spark):
    own = {("A", "f"), ("B", "f"), ("B", "g"), ("C", "h"), ("D", "g"), ("E", "x"), ("G", "x")}
    embeds = {("A", "B"), ("B", "C"), ("E", "B"), ("E", "D"), ("F", "E"), ("C", "A"), ("H", "E"), ("H", "G"), ("I", "A"), ("I", "B")}
    got = hierarchy.method_sets(spark.createDataFrame([(t, m, f"{t}.{m}") for t, m in own], "type_id string, method string, fn_id string"), spark.createDataFrame(list(embeds), "type_id string, embedded string"))

    def naive(t):
        """Method to function, None where two are at one depth, by breadth-first search."""
        found, here, seen = {}, [t], {t}
        while here:
            level = {}
            for x in here:
                for y, m in own:
                    if y == x:
                        level.setdefault(m, set()).add(f"{x}.{m}")
            for m, fns in level.items():
                found.setdefault(m, min(fns) if len(fns) == 1 else None)
            here = sorted({b for a, b in embeds if a in here} - seen)
            seen |= set(here)
        return {(t, m, f) for m, f in found.items() if f}

    assert {tuple(r) for r in got.collect()} == set().union(*(naive(t) for t in "ABCDEFGHI"))


def test_interface_calls_against_naive(spark):
    r = random.Random(6)
    has = {(f"T{k}", f"m{r.randrange(8)}") for k in range(30) for _ in range(r.randrange(6))}
    asks = {(f"I{k}", f"m{r.choice([0, 1, 2, 3, 4, 5, 6, 7, 99])}") for k in range(20) for _ in range(r.randrange(1, 4))}
    sets = {t: {m for x, m in has if x == t} for t, _ in has}
    want = {(i, t) for i in {i for i, _ in asks} for t in sets if {m for x, m in asks if x == i} <= sets[t]}
    methods = spark.createDataFrame([(t, m, f"{t}.{m}") for t, m in has], "type_id string, method string, fn_id string")
    interfaces = spark.createDataFrame(sorted(asks) * 2, "interface string, method string")
    assert {tuple(r) for r in hierarchy.implementations(methods, interfaces).collect()} == want
    calls = [(f"c{r.randrange(9)}", f"I{r.randrange(22)}", f"m{r.randrange(8)}", k) for k in range(200)]
    edges = {}
    for c, i, m, k in calls:
        for t in (t for x, t in want if x == i and (i, m) in asks):
            edges[c, f"{t}.{m}"] = min(k, edges.get((c, f"{t}.{m}"), k))
    got = hierarchy.interface_calls(spark.createDataFrame(calls, "caller string, interface string, method string, ord int"), methods, interfaces)
    assert {(x.caller, x.callee): x.ord for x in got.collect()} == edges
    values = spark.createDataFrame([("f", "func(int)", True), ("g", "func(int)", False), ("h", "func()", True)], "fn_id string, signature string, used boolean")
    asked = spark.createDataFrame([("a", "func(int)", 3), ("a", "func(int)", 1), ("b", "func(x)", 0)], "caller string, signature string, ord int")
    assert [tuple(x) for x in hierarchy.signature_calls(asked, values).collect()] == [("a", "f", 1)]


def test_code_from_tables_with_interfaces(spark):
    """A call through an interface reaches the method of the types that implement it, one of them by embedding, and no other of its name."""
    from unitflow.plans.packages import Dispatch, from_tables

    place = "struct<Filename: string, Offset: long, Line: long, Column: long>"
    rows = [(0, "p", "Read", "*File"), (1, "p", "Close", "*File"), (2, "p", "Read", "Text"), (3, "p", "Copy", ""), (4, "p", "Close", "Door"), (5, "p", "less", ""), (6, "p", "more", "")]
    functions = spark.createDataFrame([(*r, "s", "", "", None) for r in rows], f"ord int, package string, name string, receiver string, signature string, body string, doc string, position {place}")
    types = spark.createDataFrame([(k, "p", n, "struct", "", "", "", None) for k, n in enumerate(["File", "Text", "Door", "Log"])], f"ord int, package string, name string, kind string, signature string, body string, doc string, position {place}")
    calls = spark.createDataFrame([("p.Copy", "p.less", 0)], "caller string, callee string, ord long")
    symbols = spark.createDataFrame([], "package string, name string, receiver string, signature string, doc string")
    imports = spark.createDataFrame([], "package string, import string")
    asked = spark.createDataFrame([("p.Copy", "io.ReadCloser", "Read", 1), ("p.Copy", "io.ReadCloser", "Close", 2), ("p.Copy", "io.Seeker", "Seek", 3)], "caller string, interface string, method string, ord long")
    told = Dispatch(
        interfaces=spark.createDataFrame([("io.ReadCloser", "Read"), ("io.ReadCloser", "Close"), ("io.Seeker", "Seek")], "interface string, method string"),
        calls=asked,
        embeds=spark.createDataFrame([("p.Log", "p.Text"), ("p.Log", "p.Door")], "type_id string, embedded string"),
        values=spark.createDataFrame([("p.less", "func(int) bool", False), ("p.more", "func(int) bool", True)], "fn_id string, signature string, used boolean"),
        value_calls=spark.createDataFrame([("p.less", "func(int) bool", 0)], "caller string, signature string, ord long"),
    )
    made = from_tables(functions, types, calls, symbols, imports, dispatch=told)
    assert {(e.caller, e.callee) for e in made.edges.collect()} == {("p.Copy", "p.less"), ("p.less", "p.more"), *(("p.Copy", f"p.({t}).{m}") for t, m in [("*File", "Read"), ("*File", "Close"), ("Text", "Read"), ("Door", "Close")])}
    assert {u.unit_id: u.ord for u in made.calls.filter("callee = 'p.less'").collect()} == {"p.Copy": 0}


def test_covering_is_short_and_exact(spark):
    r = random.Random(2)
    spans = [(0, 0), (63, 64), (0, 63), (5, 10_000_000), (0, 2_000_000_000)] + [(a, a + r.randrange(1 << r.randrange(1, 22))) for a in (r.randrange(100_000) for _ in range(200))]
    got = spark.createDataFrame(spans, "s long, e long").select("s", "e", ranges.covering(F.col("s"), F.col("e")).alias("c")).collect()
    for g in got:
        lines = sorted((x["block"] * 64 * 4 ** x["level"], (x["block"] + 1) * 64 * 4 ** x["level"]) for x in g.c)
        assert all(a[1] == b[0] for a, b in zip(lines, lines[1:]))  # no gap, no line twice
        assert lines[0][0] <= g.s < lines[0][0] + 64 or lines[0][0] == g.s
        assert lines[-1][1] - 64 <= g.e < lines[-1][1] and len(lines) <= 6 * 13 + 2


def test_contained_in_a_huge_document_against_naive(spark):
    """Ten million lines, ranges of all lengths, three references in four at a few places: pairs as by a plain join."""
    r = random.Random(3)
    wide = [(a, r.randrange(9), a + r.choice([0, 3, 40, 700, 30_000, 9_000_000]), r.randrange(9)) for a in (r.randrange(10_000_000) for _ in range(150))] + [(0, 0, ranges.NO_END, 0)]
    refs = [(r.choice([r.randrange(10_000_000), 5_000_000 + r.randrange(40)]), r.randrange(12)) for _ in range(700)] + [(9_999_999, 0)]
    spans = spark.createDataFrame([("d", *w, k) for k, w in enumerate(wide)] + [("e", 0, 0, 5, 0, 999)], "doc string, start_line int, start_char int, end_line int, end_char int, k int")
    points = spark.createDataFrame([("d", *p, n) for n, p in enumerate(refs)] + [("f", 1, 1, -1)], "doc string, line int, char int, n int")
    got = sorted((x.n, x.k) for x in ranges.contained(points, spans, most=100).select("n", "k").collect())
    assert got == sorted((n, k) for n, p in enumerate(refs) for k, w in enumerate(wide) if w[:2] <= p < w[2:])


def test_units_and_levels(spark):
    nodes = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "fn_id string")
    edges = spark.createDataFrame([("D", "A", 0), ("A", "B", 0), ("A", "C", 1), ("B", "C", 0), ("C", "B", 0)], "caller string, callee string, ord long")
    unit_table = graph.units(graph.components(nodes, edges), edges)
    assert {u.unit_id: list(u.callees) for u in unit_table.collect()} == {"B+C": [], "A": ["B+C"], "D": ["A"]}
    assert {u.unit_id: u.level for u in graph.levels(unit_table).collect()} == {"B+C": 0, "A": 1, "D": 2}


def test_slice_lines_against_naive(spark):
    r = random.Random(3)

    def naive(text, start, line, char):
        lines = text.split("\n")
        if not 0 <= start < len(lines):
            return None
        end = max(start, min(line - (char == 0), len(lines) - 1))
        return "\n".join(lines[start : end + 1]).rstrip("\n")

    rows = [("".join(r.choice("ab\n") for _ in range(r.randrange(9))), r.randrange(5), r.randrange(-1, 6), r.randrange(3)) for _ in range(400)]
    df = spark.createDataFrame(rows, "t string, s int, l int, c int")
    got = df.select("t", "s", "l", "c", T.slice_lines(F.col("t"), F.col("s"), F.col("l"), F.col("c")).alias("x")).collect()
    assert all(g.x == naive(g.t, g.s, g.l, g.c) for g in got)


def test_locate_snippet_against_naive(spark):
    r = random.Random(4)

    def naive(body, code, hint):
        code = code.strip()
        found = [k for k, line in enumerate(body.split("\n"), 1) if code in line]
        return 0 if not code else hint if not found else found[0] if hint <= 0 else min(found, key=lambda k: (abs(k - hint), k))

    rows = [("a\n\tb()\nc", "\tb()\n", 1), ("a", " \t\n", 2), ("a\n  b\u00a0\nb", "\u00a0b\t", 3)]
    rows += [("".join(r.choice("ab\t\n ") for _ in range(r.randrange(14))), "".join(r.choice("ab\t\n ") for _ in range(r.randrange(4))), r.randrange(-1, 5)) for _ in range(400)]
    got = spark.createDataFrame(rows, "b string, c string, h int").select("b", "c", "h", T.locate_snippet(F.col("b"), F.col("c"), F.col("h")).alias("x")).collect()
    assert [g.x for g in got] == [naive(g.b, g.c, g.h) for g in got]


def test_ranges_truncate_and_contain(spark):
    defs = spark.createDataFrame([("d", "outer", 0, 0, 5, None, None), ("d", "inner", 1, 5, 5, None, None), ("d", "wide", 2, 1, 0, 9, 0), ("d", "outer", 3, 7, 0, None, None)], "doc string, symbol string, ord int, start_line int, start_char int, end_line int, end_char int")
    found = ranges.definition_ranges(defs)
    assert {r.symbol: (r.end_line, r.end_char) for r in found.collect()} == {"outer": (1, 0), "wide": (9, 0), "inner": (ranges.NO_END, 0)}
    refs = spark.createDataFrame([("d", 0, 9), ("d", 6, 0), ("d", 700, 3), ("d", 9, 0)], "doc string, line int, char int")
    got = sorted((r.line, r.symbol) for r in ranges.contained(refs, found, lines=4).collect())
    assert got == [(0, "outer"), (6, "inner"), (6, "wide"), (9, "inner"), (700, "inner")]


def test_globs_against_naive(spark):
    r = random.Random(5)

    def naive(glob, path):
        if not glob:
            return not path
        if glob[0] == "*":
            return any(naive(glob[1:], path[k:]) for k in range(len(path) + 1) if "/" not in path[:k])
        return bool(path) and (glob[0] == path[0] or (glob[0] == "?" and path[0] != "/")) and naive(glob[1:], path[1:])

    paths = ["".join(r.choice("ab./") for _ in range(r.randrange(6))) for _ in range(60)]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for globs in [["".join(r.choice("ab./*?") for _ in range(r.randrange(5))) for _ in range(r.randrange(1, 3))] for _ in range(25)]:
        got = sorted(x.p for x in df.filter(T.matches_any(F.col("p"), globs)).collect())
        assert got == sorted(p for p in paths if any(naive(g, p) for g in globs)), globs
    count = lambda globs: df.filter(T.matches_any(F.col("p"), globs)).count()
    assert count([]) == len(paths) and count(["[a"]) == count(["a\\"]) == 0 and count(["[ab]"]) == sum(p in ("a", "b") for p in paths)


def test_reachable(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("c", None)], "package string, import string")
    got = graph.reachable(spark.createDataFrame([("b",), ("lone",)], "package string"), edges)
    assert sorted(x.package for x in got.collect()) == ["a", "b", "c", "lone"]


def test_text_functions(spark):
    df = spark.createDataFrame([("file:///a/b%20c+d", "  x  y ", "critical", "héllo")], "u string, s string, v string, t string")
    row = df.select(T.strip_file_uri(F.col("u")).alias("u"), T.collapse_space(F.col("s")).alias("s"), T.sarif_level(F.col("v")).alias("v"), T.package_of(F.lit("a.b.(R).m")).alias("p"), T.strip_pointer(F.lit("*List[T]")).alias("r")).first()
    assert tuple(row) == ("/a/b c+d", "x y", "error", "a.b", "List")


def test_tables_without_a_set_folder(spark, monkeypatch):
    """spark.checkpoint.dir is a core setting, which a session can't change: a folder of the application's own stands in."""

    class Unset:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Unset(), spark.sparkContext

    monkeypatch.setattr(tables, "_LOCAL", {})
    where = tables.shared_dir(Session())
    assert where and where == tables.shared_dir(Session()) and spark.conf.get("spark.checkpoint.dir") != where
    table = written(spark.range(5))
    tables.drop_written(table)
    assert not Path(table.inputFiles()[0].removeprefix("file://")).exists()

    class Cluster:
        conf = Unset()
        sparkContext = type("Context", (), {"master": "spark://host:7077", "applicationId": "x"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(Cluster())


def test_entry_runs_without_the_corpus_operators():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
