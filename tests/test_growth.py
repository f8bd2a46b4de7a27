"""What steps write and how many rounds they take, on inputs where that once grew faster than the input; and their results there."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from unitflow.functions import tables
from unitflow.operators import graph, hierarchy


@pytest.fixture
def rows_written(monkeypatch):
    """The rows of every table that hierarchy writes."""
    found = []

    def kept(df):
        out = tables.written(df)
        found.append(out.count())
        return out

    monkeypatch.setattr(hierarchy, "written", kept)
    return found


def test_pairs_of_types_and_interfaces_are_not_written(spark, rows_written):
    """300 types have m, 300 others y, one both; 300 interfaces ask for both."""
    methods = spark.range(601).select(F.concat(F.lit("T"), "id").alias("type_id"), F.explode(F.expr("case when id < 300 then array('m') when id < 600 then array('y') else array('m', 'y') end")).alias("method"))
    interfaces = spark.range(300).select(F.concat(F.lit("I"), "id").alias("interface"), F.explode(F.array(F.lit("m"), F.lit("y"))).alias("method"))
    got = hierarchy.implementations(methods, interfaces).collect()
    assert {tuple(r) for r in got} == {(f"I{k}", "T600") for k in range(300)}
    assert max(rows_written) <= 602


@pytest.mark.parametrize("n_methods", [70, 400])
def test_sets_of_many_methods_against_naive(spark, monkeypatch, n_methods):
    """Methods in several words of bits, and more of them than bits; a grid of cells of 5 rows by 5."""
    monkeypatch.setattr(hierarchy, "SIDE", 5)
    r = random.Random(n_methods)
    names = [f"m{k}" for k in range(n_methods)]
    asks = {(f"I{k}", m) for k in range(120) for m in r.sample(names, r.randrange(1, 5))} | {("all", m) for m in names}
    sets = {}
    for i, m in sorted(asks):
        sets.setdefault(i, set()).add(m)
    has = {(f"T{k}", m) for k in range(120) for i in r.sample(sorted(set(sets) - {"all"}), 3) for m in sets[i]} | {("T0", m) for m in names}
    own = {}
    for t, m in has:
        own.setdefault(t, set()).add(m)
    want = {(i, t) for i in sets for t in own if sets[i] <= own[t]}
    methods = spark.createDataFrame([(t, m, f"{t}.{m}") for t, m in sorted(has)], "type_id string, method string, fn_id string")
    interfaces = spark.createDataFrame(sorted(asks), "interface string, method string")
    assert sorted(tuple(x) for x in hierarchy.implementations(methods, interfaces).collect()) == sorted(want)
    calls = [(f"c{r.randrange(3)}", i, r.choice(sorted(sets[i])), k) for k, i in enumerate(r.choices(sorted(sets), k=300))]
    edges = {}
    for c, i, m, k in calls:
        for t in (t for x, t in want if x == i):
            edges[c, f"{t}.{m}"] = min(k, edges.get((c, f"{t}.{m}"), k))
    got = hierarchy.interface_calls(spark.createDataFrame(calls, "caller string, interface string, method string, ord int"), methods, interfaces).collect()
    assert len(got) == len(edges) and {(x.caller, x.callee): x.ord for x in got} == edges


def shuffled(spark) -> int:
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    return sum(x.totalShuffleWrite() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(context.statusStore().executorList(False)))


def test_a_text_moves_once_however_many_functions_it_has(spark):
    """One text of 400 kB that doesn't compress, with 100 functions: edges and units are made without it, bodies with one copy."""
    from unitflow.plans.extract import extract_index

    r = random.Random(2)
    lines = ["".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(130)) for _ in range(1000)]
    docs = spark.createDataFrame([("i", 0, "a.x", "X", "\n".join(lines), "")], "path string, ord int, doc string, language string, text string, root string")
    rows = spark.range(100).select(F.lit("i").alias("path"), F.lit("a.x").alias("doc"), F.lit(0).alias("doc_ord"), F.col("id").cast("int").alias("ord"), F.expr("'s m p v a/f' || id || '().'").alias("symbol"))
    symbols = rows.select("*", F.lit("Function").alias("kind"), F.lit("").alias("display"), F.lit("s").alias("signature"), F.array(F.lit("d")).alias("documentation"))
    none = F.array().cast("array<int>")
    defined = rows.select("*", F.lit(1).alias("roles"), F.array(F.col("ord") * 10, F.lit(0), F.lit(1)).alias("range"), none.alias("enclosing"))
    used = rows.select("path", "doc", "doc_ord", (F.col("ord") + 100).alias("ord"), F.expr("'s m p v a/f' || (99 - ord) || '().'").alias("symbol"), F.lit(0).alias("roles"), F.array(F.col("ord") * 10 + 1, F.lit(0), F.lit(1)).alias("range"), none.alias("enclosing"))
    told = symbols.limit(0).select("path", "ord", "symbol", "kind", "display", "signature", "documentation")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = shuffled(spark)
        ex = extract_index(spark, {"documents": docs, "symbols": symbols, "occurrences": defined.unionByName(used), "external_symbols": told})
        assert ex.edges.count() == 100
        between = shuffled(spark)
        bodies = {x["name"]: x["body"] for x in ex.functions.collect()}
        after = shuffled(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert bodies == {f"f{k}": "\n".join(lines[k * 10 : k * 10 + 10]) for k in range(100)}
    size = len("\n".join(lines).encode())
    assert between - before < size and after - between < 2 * size


def test_short_rings_take_few_rounds(spark, monkeypatch):
    """2,000 rings of 1 to 5 nodes and chains beside them: rounds as their length asks for, not as their number does."""
    tables_, edges, want = [], [], {}
    monkeypatch.setattr(graph, "written", lambda df: tables_.append(1) or tables.written(df))
    r = random.Random(3)
    for k in range(2000):
        nodes = [f"n{k:04}{c}" for c in r.sample("abcde", r.randrange(1, 6))]
        edges += [(a, b) for a, b in zip(nodes, nodes[1:])] + ([(nodes[-1], nodes[0])] if k % 2 else [])
        want |= {n: min(nodes) if k % 2 else n for n in nodes}
    got = graph.components(spark.createDataFrame([(n,) for n in want], "fn_id string"), spark.createDataFrame(edges, "caller string, callee string"))
    assert {x["fn_id"]: x["scc"] for x in got.collect()} == want
    assert len(tables_) < 24


def test_long_chains_are_followed_in_rows_that_grow_with_them(spark, monkeypatch):
    """A chain of 3,000 nodes in no order: all tables together hold a few times its links, not log2(3,000) times as many."""
    sizes = []

    def kept(df):
        out = tables.written(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "written", kept)
    monkeypatch.setattr(graph, "FEW", 100, raising=False)
    r = random.Random(4)
    nodes = r.sample(range(10**6), 3000)
    links = spark.createDataFrame([(a, 0, b, 1) for a, b in zip(nodes, nodes[1:])], "id long, base long, b long, w long")
    got = graph.followed(links, 2999).collect()
    assert {x["id"]: (x["b"], x["w"]) for x in got} == {a: (nodes[-1], 2999 - k) for k, a in enumerate(nodes[:-1])}
    assert sum(sizes) < 8 * 2999


@pytest.mark.parametrize("few", [10, 250_000])
def test_forests_are_followed_like_naive(spark, monkeypatch, few):
    """Chains, stars, bushes, single links, and several ends; links with bases and weights."""
    monkeypatch.setattr(graph, "FEW", few, raising=False)
    r = random.Random(5)
    names = r.sample(range(10**6), 700)
    at = [(k, -1 - k % 3 if k % 97 == 0 else k - 1 if k < 300 else r.choice([299, k % 97 // 4 * 4, r.randrange(k)])) for k in range(700)]
    node = lambda k: names[k] if k >= 0 else 10**7 - k
    base, w = [r.randrange(0, 900) for _ in at], [r.randrange(1, 9) for _ in at]
    want = {}
    for k, to in at:
        b, steps, least = want.get(to, (node(to), 0, 0))
        want[k] = b, w[k] + steps, max(base[k], w[k] + least)
    got = graph.followed(spark.createDataFrame([(node(k), base[k], node(to), w[k]) for k, to in at], "id long, base long, b long, w long"), 700).collect()
    assert len(got) == 700 and {x["id"]: (x["b"], x["w"], x["base"]) for x in got} == {node(k): v for k, v in want.items()}


def test_levels_of_layers_with_chains_between_them_against_naive(spark):
    """Nodes of four layers call several lower ones, straight or through chains, some of which join."""
    r = random.Random(6)
    calls, layers, n = {}, [[f"n{k}" for k in range(8)]], 8
    for _ in range(4):
        lower = [x for layer in layers for x in layer]
        for _ in range(12):
            calls[f"n{n}"], n = {r.choice(lower)}, n + 1
            lower.append(f"n{n - 1}")
        layers.append([f"n{n + k}" for k in range(8)])
        calls |= {x: set(r.choices(lower, k=r.randrange(1, 5))) for x in layers[-1]}
        n += 8
        layers[-1] += lower[-12:]
    level = {}
    for x in (f"n{k}" for k in range(n)):
        level[x] = max((level[c] + 1 for c in calls.get(x, ())), default=0)
    found = graph.unit_levels(spark.createDataFrame([(x,) for x in level], "unit_id string"), spark.createDataFrame([(x, c) for x, to in calls.items() for c in sorted(to)], "unit_id string, callee string"))
    assert {x["unit_id"]: x["level"] for x in found.collect()} == level


def test_a_table_of_rare_keys_is_not_shuffled_to_count_them(spark):
    from unitflow.operators.joins import hot_keys

    rare = tables.written(spark.range(200_000).select(F.xxhash64("id").alias("k")))
    before = shuffled(spark)
    assert hot_keys(rare, ["k"], most=5000) is None and shuffled(spark) - before < 400_000
    both = tables.written(rare.unionByName(spark.range(9000).select(F.lit(7).cast("long").alias("k"))))
    assert [tuple(x) for x in hot_keys(both, ["k"], most=5000)[0].collect()] == [(7, 2)]


def test_requests_are_asked_without_writing_them_first(spark, tmp_path, monkeypatch):
    from unitflow.plans import review as plan

    monkeypatch.setattr(plan, "written", None)
    state = plan.State(spark, plan.Config(state=str(tmp_path)))
    rows = lambda *ids: spark.createDataFrame([(i, "summary", "{}") for i in ids], "id string, pass string, context string")
    ask = lambda rows, counts: rows.select("id", "pass", F.concat("id", "context").alias("payload"))
    for ids in ("a", "ab"):
        assert sorted(tuple(r) for r in state.keep("x", rows(*ids), ask).collect()) == [(i, "summary", i + "{}") for i in ids]


def test_a_stage_has_a_bounded_number_of_tasks(spark, tmp_path, monkeypatch):
    """However many requests there are: 20 of them at one a task would be 20 tasks and 20 files, 10 million would be 10 million."""
    from unitflow.plans import review as plan

    monkeypatch.setattr(plan, "TASKS", 3, raising=False)
    state = plan.State(spark, plan.Config(state=str(tmp_path), step=1))
    rows = lambda n: spark.createDataFrame([(f"u{k}", "summary", "{}") for k in range(n)], "id string, pass string, context string")
    seen = []
    ask = lambda rows, counts: seen.append(rows.rdd.getNumPartitions()) or rows.select("id", "pass", F.concat("id", "context").alias("payload"))
    state.keep("x", rows(1), ask)
    got = state.keep("x", rows(20), ask).collect()
    assert sorted(tuple(r) for r in got) == sorted((f"u{k}", "summary", f"u{k}{{}}") for k in range(20))
    assert seen[-1] == 3 and state.tasks(10_000_000) == 3 and state.tasks(2) == 2


def test_lines_and_symbols_are_cut_and_parsed_once(spark, tmp_path):
    """A document's lines are not cut again for every one of them, and what language an index is in asks for no second parse."""
    from unitflow.plans import queries

    docs = spark.createDataFrame([(1, "\n".join(f"a e {k}" for k in range(40)), "en", "web"), (2, "", None, "web")], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().replace(", \n, -1", "")
    index = queries.doc_index(spark, str(tmp_path))
    cut = [line for line in plan(index["occurrences"]).split("\n") if "split(" in line]
    assert cut and all("posexplode" not in line and (" AS lines#" in line or "Filter" in line) for line in cut)
    ex = queries.doc_units(spark, str(tmp_path))
    assert "MapInArrow" not in plan(ex.language) and [r[0] for r in ex.language.collect()] == ["en"]
    assert ex.functions.count() == 8 and ex.types.count() == 5  # the empty text is one line, which defines a type


def test_cells_grow_where_their_number_would_grow_with_pairs(spark, monkeypatch):
    """n interfaces and n types with one method: rows are dealt to as many cells at twice n, not to twice as many each."""
    monkeypatch.setattr(hierarchy, "SIDE", 10)
    rows = lambda n, letter, bits, name: spark.range(n).select(F.concat(F.lit(letter), "id").alias(name), F.lit("m").alias("method"), F.expr(bits).alias(f"{'a' if letter == 'I' else 'h'}0"))
    for n in (300, 600):
        met = hierarchy._meeting(rows(n, "I", "1L", "interface"), rows(n, "T", "id % 2", "type_id"), 1)
        assert met.rdd.getNumPartitions() <= 64
        assert met.count() == met.distinct().count() == n * n // 2
