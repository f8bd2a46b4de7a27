"""Units of a call graph: strongly connected components in callees-first order.

Nodes are numbered, and every step is a few joins over written tables of numbers; nothing but counts comes to the driver. What makes
a graph deep is taken out first: chains are followed by pointer jumping, in as many rounds as the logarithm of their length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from unitflow.functions.tables import drop_written, written
from unitflow.operators import lookups
from unitflow.operators.joins import split_join

#: So many links are followed by doubling steps, which move all of them in every round.
FEW = 250_000


def _counted(df: DataFrame, **what) -> tuple[DataFrame, dict]:
    """df as a written table with aggregates observed while it is written; n is the number of its rows."""
    seen = Observation()
    table = written(df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in what.items()]))
    return table, {name: v or 0 for name, v in seen.get.items()}


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def numbered(names: DataFrame, name: str) -> DataFrame:
    """The distinct names with id, a number each."""
    return written(names.select(name).filter(F.col(name).isNotNull()).distinct().withColumn("id", F.monotonically_increasing_id()))


def _in_numbers(edges: DataFrame, names: DataFrame, name: str, a: str, b: str) -> DataFrame:
    """edges (a, b: names) as distinct numbers (a, b); edges with an unknown end and loops go."""
    both = written(edges.select(F.col(a).alias("_a"), F.col(b).alias("_b")).filter("_a <> _b"))
    both = split_join(both, names.select(F.col(name).alias("_a"), F.col("id").alias("a")), ["_a"]).select("a", "_b")
    both = split_join(written(both), names.select(F.col(name).alias("_b"), F.col("id").alias("b")), ["_b"])
    return written(both.select("a", "b").distinct())


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (fn_id) and edges (caller, callee, ...) to (fn_id, scc): scc is the least member of a node's strongly connected component.
    Edges to or from what is no node don't count; repeated rows and loops change nothing; null ids go."""
    names = numbered(nodes, "fn_id")
    found = strongly_connected(_in_numbers(edges, names, "fn_id", "caller", "callee"))
    if found is None:
        return names.select("fn_id", F.col("fn_id").alias("scc"))
    roots = found.select(F.col("root").alias("id")).distinct().withColumn("root", F.col("id"))
    named = written(found.filter("id <> root").unionByName(roots).join(names, "id").select("fn_id", "root"))
    least = named.groupBy("root").agg(F.min("fn_id").alias("scc"))
    scc = split_join(named, least, ["root"]).select("fn_id", "scc")
    return names.join(scc, "fn_id", "left").select("fn_id", F.coalesce("scc", "fn_id").alias("scc"))


def strongly_connected(edges: DataFrame) -> DataFrame | None:
    """edges (a, b: numbers, distinct, no loops) to (id, root) for the members of components of two nodes or more, root being one of
    them (its own row may be missing); None where there is no such component.

    Ends and chains go first (contracted). What is left is cut from many pivots at once: the least number that reaches a node, and,
    among nodes of one such label, the least number it reaches. Where both are the same, the node belongs to that pivot's component;
    else components lie within equal pairs of labels, and edges between different ones go."""
    found, chains = [], []
    left = edges
    while True:
        left, more, cycles = contracted(left)
        chains += more
        found += cycles
        if left is None:
            break
        fore = spread(left)
        of = lambda table, name, to: table.select(F.col("id").alias(name), F.col("label").alias(to))
        same = left.join(of(fore, "a", "la"), "a").join(of(fore, "b", "lb"), "b").filter("la = lb")
        same, seen = _counted(same.select("a", "b", F.col("la").alias("fore")))
        drop_written(left)
        if not seen["n"]:
            break
        back = spread(same.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = back.select("id", F.col("label").alias("back")).join(fore.select("id", F.col("label").alias("fore")), "id")
        found.append(written(both.filter("back = fore").select("id", F.col("fore").alias("root"))))
        rest = same.join(of(back, "a", "la"), "a").join(of(back, "b", "lb"), "b").filter("la = lb and la <> fore")
        left = written(rest.select("a", "b"))
        drop_written(same, fore, back)
    # chains lie on a cycle where their ends do, or where both ends are one node; later chains know more
    for table in reversed(chains):
        at = written(_union(found)) if found else table.select("id", F.col("id").alias("root")).limit(0)
        head = split_join(table, at.select(F.col("id").alias("head"), F.col("root").alias("h")), ["head"], "left")
        tail = split_join(written(head), at.select(F.col("id").alias("tail"), F.col("root").alias("t")), ["tail"], "left")
        on = tail.select("id", F.coalesce("h", "head").alias("h"), F.coalesce("t", "tail").alias("t")).filter("h = t")
        found.append(written(on.select("id", F.col("h").alias("root"))))
    return written(_union(found)) if found else None


def contracted(edges: DataFrame) -> tuple[DataFrame | None, list[DataFrame], list[DataFrame]]:
    """The graph without nodes that nothing leads to or from, and with every chain (nodes with one edge in and one out) replaced by one
    edge, again and again until nothing changes: (edges or None if none are left, chains (id, head, tail), cycles (id, root)) of
    the rounds. The edges are given up for those that come back."""
    chains, cycles = [], []
    while True:
        out = edges.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n_out"), F.min("b").alias("next"))
        into = edges.groupBy(F.col("b").alias("id")).agg(F.count(F.lit(1)).alias("n_in"), F.min("a").alias("prev"))
        dead, chain = F.col("n_out").isNull() | F.col("n_in").isNull(), (F.col("n_out") == 1) & (F.col("n_in") == 1)
        kinds = out.join(into, "id", "full").select("id", "prev", "next", dead.alias("dead"), F.coalesce(chain, F.lit(False)).alias("chain"))
        kinds, seen = _counted(kinds.filter("dead or chain"), dead=F.sum(F.col("dead").cast("int")), chain=F.sum(F.col("chain").cast("int")))
        if not seen["n"]:
            break
        gone = kinds.filter("dead").select("id")
        if seen["chain"]:
            followed, closed = jumped(kinds.filter("chain").select("id", "prev", "next"), seen["chain"])
            chains.append(followed)
            cycles += closed
            tails = followed.select(F.col("id").alias("b"), "tail")
            inner = followed.select(F.col("id").alias("a"))
            cut = [c.select(F.col("id").alias("a")) for c in closed]
            rest = edges.join(_union([inner, *cut]), "a", "left_anti").join(tails, "b", "left").select("a", F.coalesce("tail", "b").alias("b")).filter("a <> b").distinct()
        else:
            rest = edges
        rest = rest.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti")
        before = edges
        edges, seen = _counted(rest.select("a", "b"))
        drop_written(before, kinds)
        if not seen["n"]:
            return None, chains, cycles
    return edges, chains, cycles


def jumped(links: DataFrame, n: int) -> tuple[DataFrame, list[DataFrame]]:
    """links (id, prev, next) of n nodes to (id, head, tail), the first nodes before and behind that aren't among them, by doubling steps
    on both sides; links that close a cycle come apart as (id, root), in a list of one table or none.

    Every round fewer nodes of a chain point into it, and on a cycle some node learns of a lower one until all know the least. So a
    round without either is the last: the logarithm of the longest chain or cycle counts, not that of n."""
    now = written(links.select("id", "prev", "next", F.col("id").alias("low"), F.lit(True).alias("open")))
    inside = None
    for _ in range(n.bit_length() + 1):
        ahead = now.select(F.col("id").alias("next"), F.col("next").alias("far"), F.col("low").alias("far_low"))
        behind = now.select(F.col("id").alias("prev"), F.col("prev").alias("near"))
        step = now.select("id", "prev", "next", "low").join(ahead, "next", "left").join(behind, "prev", "left")
        on, back = F.col("far").isNotNull(), F.col("near").isNotNull()
        step = step.select("id", F.coalesce("near", "prev").alias("prev"), F.coalesce("far", "next").alias("next"), F.least("low", "far_low").alias("low"), (on | back).alias("open"), on.alias("on"), back.alias("back"), F.coalesce(F.col("far_low") < F.col("low"), F.lit(False)).alias("lower"))
        before = now
        now, seen = _counted(step, **{c: F.sum(F.col(c).cast("int")) for c in ("open", "on", "back", "lower")})
        drop_written(before)
        if not seen["open"] or (inside == (seen["on"], seen["back"]) and not seen["lower"]):
            break
        inside = seen["on"], seen["back"]
    ends = now.filter("not open").select("id", F.col("prev").alias("head"), F.col("next").alias("tail"))
    return ends, [now.filter("open").select("id", F.col("low").alias("root"))] if seen["open"] else []


def spread(edges: DataFrame) -> DataFrame:
    """edges (a, b) to (id, label): the least number that reaches a node, itself included. In every round a node takes the least label
    before it and then that label's own label, so labels jump ahead instead of going one edge a round."""
    labels = written(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("label", F.col("id")))
    while True:
        least = edges.join(labels.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min("label").alias("new"))
        near = written(labels.join(least, "id", "left").select("id", F.col("label").alias("old"), F.least("label", "new").alias("label")))
        far = split_join(near, labels.select(F.col("id").alias("label"), F.col("label").alias("far")), ["label"], "left")
        after, seen = _counted(far.select("id", F.least("label", "far").alias("label"), "old"), moved=F.sum((F.col("label") < F.col("old")).cast("int")))
        drop_written(near, labels)
        labels = after.select("id", "label")
        if not seen["moved"]:
            return labels


def unit_names(members: DataFrame) -> DataFrame:
    """members (fn_id, scc) to scc, unit_id (sorted members joined by +) and n_members."""
    return members.groupBy("scc").agg(F.array_join(F.array_sort(F.collect_set("fn_id")), "+").alias("unit_id"), F.countDistinct("fn_id").alias("n_members"))


def unit_calls(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members (fn_id, scc) and edges (caller, callee, ord) to scc, callee_scc and first (caller, ord), a row for two units of which one
    calls the other: the first call over the caller's sorted members and each one's edge order."""
    of = lambda name, to: members.select(F.col("fn_id").alias(name), F.col("scc").alias(to))
    named = written(edges.select("caller", "callee", "ord").join(of("caller", "scc"), "caller"))
    both = split_join(named, of("callee", "callee_scc"), ["callee"]).filter("scc <> callee_scc")
    return both.groupBy("scc", "callee_scc").agg(F.min(F.struct("caller", "ord")).alias("first"))


def ordered_calls(members: DataFrame, edges: DataFrame) -> DataFrame:
    """unit_id, ord and callee: what a unit calls, numbered from 0 in first-seen order. A row a callee, so that a unit of any number of
    callees lies over many tasks."""
    names = unit_names(members).select("scc", "unit_id")
    calls = lookups.positions(unit_calls(members, edges), ["scc"], ["first"]).drop("first")
    calls = written(calls.join(names, "scc"))
    return split_join(calls, names.select(F.col("scc").alias("callee_scc"), F.col("unit_id").alias("callee")), ["callee_scc"]).select("unit_id", F.col("ord").cast("int").alias("ord"), "callee")


def units(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Units with their callees as arrays: scc, unit_id, n_members, callees in first-seen order."""
    named = unit_names(members)
    calls = written(unit_calls(members, edges))
    calls = split_join(calls, named.select(F.col("scc").alias("callee_scc"), F.col("unit_id").alias("callee_unit")), ["callee_scc"])
    calls = calls.groupBy("scc").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "callee_unit"))), lambda x: x["callee_unit"]).alias("callees"))
    return named.join(calls, "scc", "left").withColumn("callees", F.coalesce("callees", F.array().cast("array<string>")))


def levels(unit_table: DataFrame) -> DataFrame:
    """unit_id and callees (units, a DAG) to unit_id and level: 0 without callees, else one more than the highest callee."""
    return unit_levels(unit_table.select("unit_id"), unit_table.select("unit_id", F.explode("callees").alias("callee")))


def unit_levels(unit_ids: DataFrame, calls: DataFrame) -> DataFrame:
    """unit_ids (unit_id) and calls (unit_id, callee; a DAG) to unit_id and level."""
    names = numbered(unit_ids, "unit_id")
    deep = depths(names.select("id"), _in_numbers(calls, names, "unit_id", "unit_id", "callee"))
    return names.join(deep, "id").select("unit_id", F.col("level").cast("int").alias("level"))


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (id) and edges (a, b: distinct, a DAG) to (id, level), the longest path from a node.

    A node with one open edge has the level max(base, steps + level of its end), and such functions put together are of the same form:
    chains and trees of them are followed by pointer jumping and leave the graph, edges to them go on to their ends. Edges to nodes
    of known level become part of base. So a round takes out all that hangs by single edges, however deep. The edges are given up."""
    live = nodes.select("id", F.lit(0).cast("long").alias("base"))
    open_edges, n_open = edges.select("a", "b", F.lit(1).cast("long").alias("w")), edges.count()
    done, waiting = [], []
    while True:
        single = F.when(F.count(F.lit(1)) == 1, F.min(F.struct("b", "w")))
        out = open_edges.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n"), single.alias("only"))
        now = written(live.join(out, "id", "left").select("id", "base", F.coalesce("n", F.lit(0)).alias("n"), "only.b", "only.w"))
        ready = now.filter("n = 0").select("id", F.col("base").alias("level"))
        fresh = [ready]
        links = now.filter("n = 1").select("id", "base", "b", "w")
        n = links.count()
        if n:
            links = followed(links, n)
            # of what hangs by single edges, that which ends at a known level is known; the rest waits for its end
            ends = split_join(links, ready.select(F.col("id").alias("b"), "level"), ["b"], "left")
            ends = written(ends.withColumn("level", F.when(F.col("level").isNotNull(), F.greatest("base", F.col("w") + F.col("level")))))
            fresh.append(ends.filter("level is not null").select("id", "level"))
            waiting.append(ends.filter("level is null").select("id", "base", "b", "w"))
        fresh = written(_union(fresh))
        done.append(fresh)
        many = now.filter("n > 1").select("id", "base")
        if not n_open or many.isEmpty():
            drop_written(open_edges, now)
            break
        kept = written(open_edges.join(many.select(F.col("id").alias("a")), "a", "left_semi"))
        # an edge leads to a node of known level, to one that waits for its end, or to one with several edges
        none = F.lit(None).cast("long")
        to = fresh.select(F.col("id").alias("b"), "level", none.alias("base"), none.alias("end"), none.alias("more"))
        if n:
            to = to.unionByName(waiting[-1].select(F.col("id").alias("b"), none.alias("level"), "base", F.col("b").alias("end"), F.col("w").alias("more")))
        told = split_join(kept, to, ["b"], "left")
        told = told.select("a", F.coalesce("end", "b").alias("b"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), (F.col("w") + F.coalesce("level", "base")).alias("least"), F.col("level").isNotNull().alias("known"))
        told, seen = _counted(told.groupBy("a", "b", "known").agg(F.max("w").alias("w"), F.max("least").alias("least")), known=F.sum(F.col("known").cast("int")))
        before = open_edges
        open_edges, n_open = told.filter("not known").select("a", "b", "w"), seen["n"] - seen["known"]
        base = told.filter("least is not null").groupBy(F.col("a").alias("id")).agg(F.max("least").alias("least"))
        live = written(many.join(base, "id", "left").select("id", F.greatest("base", "least").alias("base")))
        drop_written(before, now, kept)
    for table in reversed(waiting):
        known = _union(done).select(F.col("id").alias("b"), F.col("level").alias("to"))
        done.append(written(split_join(table, known, ["b"]).select("id", F.greatest("base", F.col("w") + F.col("to")).alias("level"))))
    return _union(done)


def followed(links: DataFrame, n: int) -> DataFrame:
    """links (id, base, b, w) of n nodes without a cycle, each standing for x -> max(base, w + x) of b: the same with b outside them.

    Steps that double would move every link in each of as many rounds as the logarithm of the longest chain. So while there are over
    FEW, nodes are left out instead: in every round a hash makes half of the nodes odd; odd ones before even ones are left out, and
    links to these go on to the even one. That takes out a fourth of the links a round and two nodes in a row never, so all rounds
    together move a few times n rows. A link found to be at its end is left out where it is odd. The rest is followed by doubling, and
    then round by round, the last first, the nodes left out go on from where they lead."""
    odd = lambda name, k: F.pmod(F.xxhash64(F.col(name), F.lit(k)), F.lit(2)) == 1
    rounds, now = [], links.withColumn("ended", F.lit(False))
    while n > FEW:
        k = len(rounds)
        asks = ~F.col("ended") & odd("b", k)
        out = odd("id", k) & (F.col("ended") | ~odd("b", k))
        # only links to odd nodes ask: whether these are left out, stay, or are none of the nodes
        ahead = now.filter(odd("id", k)).select(F.col("id").alias("b"), *[F.when(out, F.col(c)).alias(f"{c}2") for c in ("base", "b", "w")], (out & F.col("ended")).alias("ended2"))
        asked = split_join(now.filter(asks), ahead, ["b"], "left").select(*_on(), F.coalesce("ended2", F.lit(True)).alias("ended"))
        rounds.append((now, out))
        now, seen = _counted(asked.unionByName(now.filter(~asks & ~out)))
        n = seen["n"]
    passed = [before for before, _ in rounds[1:]] + [now] * bool(rounds)
    left_out = [before.filter(out).filter("ended").drop("ended") for before, out in rounds]
    now = now.drop("ended")
    doubled = []
    for _ in range(n.bit_length() + 1):
        step = split_join(now, now.select(F.col("id").alias("b"), *[F.col(c).alias(f"{c}2") for c in ("base", "b", "w")]), ["b"], "left")
        now, seen = _counted(step.select(*_on(), F.col("b2").isNotNull().alias("open")), open=F.sum(F.col("open").cast("int")))
        doubled.append(now)
        now = now.drop("open")
        if not seen["open"]:
            break
    drop_written(*doubled[:-1])
    found = [*left_out, now]
    for k, (before, out) in reversed(list(enumerate(rounds))):
        # what a node left out leads to is even
        known = _union(found).filter(~odd("id", k)).select(F.col("id").alias("b"), *[F.col(c).alias(f"{c}2") for c in ("base", "b", "w")])
        found.append(written(split_join(before.filter(out).filter("not ended").drop("ended"), known, ["b"], "left").select(*_on())))
    table = written(_union(found))
    drop_written(*passed, *found[len(left_out) :])
    return table


def _on() -> list:
    """A link put together with that of its end (base2, b2, w2), where there is one."""
    return ["id", F.greatest("base", F.col("w") + F.col("base2")).alias("base"), F.coalesce("b2", "b").alias("b"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w")]


def ordered(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members (fn_id, scc) with ordinal: the place of their component by (level, scc), so callees first."""
    of = lambda name, to: members.select(F.col("fn_id").alias(name), F.col("scc").alias(to))
    calls = edges.select("caller", "callee").join(of("caller", "unit_id"), "caller").join(of("callee", "to"), "callee").filter("unit_id <> to")
    deep = unit_levels(members.select(F.col("scc").alias("unit_id")), calls.select("unit_id", F.col("to").alias("callee")).distinct())
    places = lookups.placed(deep, ["level", "unit_id"]).select(F.col("unit_id").alias("scc"), (F.col("place") - 1).cast("int").alias("ordinal"))
    return members.join(places, "scc").select("fn_id", "scc", "ordinal")


def reachable(starts: DataFrame, edges: DataFrame, node: str = "package", to: str = "import") -> DataFrame:
    """starts (node) and what they lead to over edges (node, to), distinct: one round a step, each from what the last one found."""
    steps = written(edges.select(node, to).filter(f"{to} is not null").distinct())
    found = new = written(starts.select(node).filter(f"{node} is not null").distinct())
    while not new.isEmpty():
        new = written(steps.join(new, node).select(F.col(to).alias(node)).distinct().join(found, node, "left_anti"))
        found = written(found.unionByName(new))
    return found


def closure(edges: DataFrame) -> DataFrame:
    """All (caller, reached) over one edge or more, by doubling paths."""
    paths = written(edges.select("caller", F.col("callee").alias("reached")).distinct())
    size = 0
    while size != (n := paths.count()):
        size = n
        more = paths.join(paths.select(F.col("caller").alias("reached"), F.col("reached").alias("next")), "reached").select("caller", F.col("next").alias("reached"))
        paths = written(paths.unionByName(more).distinct())
    return paths
