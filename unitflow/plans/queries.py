"""Queries of the driver contract: each operator over a stand-in among the shared tables, with DuckDB SQL for it."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from unitflow.functions import languages
from unitflow.functions import text as T
from unitflow.functions.models import KeyedClient
from unitflow.functions.tables import written
from unitflow.operators import graph, hierarchy, lookups, ranges
from unitflow.operators.joins import split_join
from unitflow.plans.extract import Extracted, extract_index
from unitflow.plans.packages import external_functions
from unitflow.plans.review import Config, Pass, review

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nation_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each customer nation calls the nation that supplies most of its lines, the least on ties."""
    get = lambda n: table(spark, sf_dir, n)
    counts = (
        get("lineitem").select("l_orderkey", "l_suppkey")
        .join(get("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        .join(get("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
        .join(get("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
        .groupBy("c_nationkey", "s_nationkey")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    top = counts.groupBy("c_nationkey").agg(F.min(F.struct((-F.col("n")).alias("n"), "s_nationkey")).alias("t"))
    nodes = get("nation").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("fn_id"))
    return nodes, top.select(F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("caller"), F.lpad(F.col("t.s_nationkey").cast("string"), 2, "0").alias("callee"), F.lit(0).cast("long").alias("ord"))


def nation_graph(spark: SparkSession, sf_dir: str):
    nodes, edges = nation_edges(spark, sf_dir)
    edges = written(edges)  # a row a nation, behind a join of four tables that is made once
    members = graph.components(nodes, edges)
    return nodes, edges, members, graph.units(members, edges)


NATION = """
with recursive counts as (
  select c_nationkey, s_nationkey, count(*) as n from lineitem join orders on o_orderkey = l_orderkey
  join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey group by 1, 2),
edges as (
  select lpad(c_nationkey::varchar, 2, '0') as caller, lpad(s_nationkey::varchar, 2, '0') as callee
  from (select *, row_number() over (partition by c_nationkey order by n desc, s_nationkey) as k from counts) where k = 1),
nodes as (select lpad(n_nationkey::varchar, 2, '0') as fn_id from nation),
reach as (select caller, callee from edges union select r.caller, e.callee from reach r join edges e on e.caller = r.callee),
scc as (
  select fn_id, least(fn_id, coalesce(min(a.callee), fn_id)) as scc from nodes
  left join (select x.caller, x.callee from reach x join reach y on y.caller = x.callee and y.callee = x.caller) a on a.caller = fn_id group by fn_id),
named as (select scc, string_agg(fn_id, '+' order by fn_id) as unit_id, count(*) as n_members from scc group by scc),
calls as (
  select a.scc, b.scc as callee_scc, min(e.caller) as first_caller from edges e join scc a on a.fn_id = e.caller join scc b on b.fn_id = e.callee
  where a.scc <> b.scc group by 1, 2),
depth as (select scc, 0 as level from named union select c.scc, d.level + 1 from depth d join calls c on c.callee_scc = d.scc)
"""


@query(NATION + """
select n.unit_id, n.n_members::bigint as n_members, coalesce((select string_agg(m.unit_id, ',' order by c.first_caller) from calls c join named m on m.scc = c.callee_scc where c.scc = n.scc), '') as callees
from named n""")
def nation_units(spark, sf_dir):
    *_, unit_table = nation_graph(spark, sf_dir)
    return unit_table.select("unit_id", F.col("n_members").cast("long").alias("n_members"), F.array_join("callees", ",").alias("callees"))


@query(NATION + "select n.unit_id, max(d.level)::int as level from named n join depth d on d.scc = n.scc group by 1")
def level_eval(spark, sf_dir):
    *_, unit_table = nation_graph(spark, sf_dir)
    return graph.levels(unit_table).select("unit_id", "level")


@query(NATION + "select distinct caller, callee as reached from reach")
def closure_reach(spark, sf_dir):
    return graph.closure(nation_edges(spark, sf_dir)[1])


@query(NATION + "select n.unit_id, m.unit_id as callee from calls c join named n on n.scc = c.scc join named m on m.scc = c.callee_scc")
def unit_callees(spark, sf_dir):
    *_, unit_table = nation_graph(spark, sf_dir)
    return unit_table.select("unit_id", F.explode("callees").alias("callee"))


@query("select 'u' || user_id as caller, (row_number() over (partition by user_id order by min(event_id)) - 1)::int as ord, 'e' || (value * 100)::bigint as callee from events group by user_id, (value * 100)::bigint")
def ordered_callees(spark, sf_dir):
    """Users as units that call what their events' values stand for, in first-seen order."""
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("caller"), F.concat(F.lit("e"), F.expr("cast(round(value * 100) as bigint)").cast("string")).alias("callee"), F.col("event_id").alias("ord"))
    nodes = events.select(F.col("caller").alias("fn_id")).union(events.select("callee")).distinct()
    calls = graph.ordered_calls(nodes.withColumn("scc", F.col("fn_id")), events)
    return calls.select(F.col("unit_id").alias("caller"), "ord", "callee")


@query("""
with recursive steps as (select event_type as a, lead(event_type) over (partition by user_id order by ts, event_id) as b from events),
edges as (select distinct a, b from steps where b is not null), nodes as (select distinct event_type as fn_id from events),
reach as (select a, b from edges union select r.a, e.b from reach r join edges e on e.a = r.b)
select fn_id, least(fn_id, coalesce(min(x.b), fn_id)) as scc from nodes left join (select p.a, p.b from reach p join reach q on q.a = p.b and q.b = p.a) x on x.a = fn_id group by fn_id""")
def event_transition_scc(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    steps = events.select(F.col("event_type").alias("caller"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("callee"))
    edges = steps.filter("callee is not null").distinct().withColumn("ord", F.dense_rank().over(Window.partitionBy("caller").orderBy("callee")).cast("long"))
    nodes = events.select(F.col("event_type").alias("fn_id")).distinct()
    return graph.components(nodes, edges)


def order_rings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every order calls its customer's next one; the last order of customers with an even key calls the first, so these close."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("fn_id"))
    own = Window.partitionBy("o_custkey").orderBy("fn_id")
    first = F.when(F.col("o_custkey") % 2 == 0, F.min("fn_id").over(Window.partitionBy("o_custkey")))
    edges = orders.select(F.col("fn_id").alias("caller"), F.coalesce(F.lead("fn_id").over(own), first).alias("callee"), F.lit(0).cast("long").alias("ord"))
    return orders.select("fn_id"), edges.filter("callee is not null")


@query("select lpad(o_orderkey::varchar, 12, '0') as fn_id, case when o_custkey % 2 = 0 then min(lpad(o_orderkey::varchar, 12, '0')) over (partition by o_custkey) else lpad(o_orderkey::varchar, 12, '0') end as scc from orders")
def ring_components(spark, sf_dir):
    return graph.components(*order_rings(spark, sf_dir)).select("fn_id", "scc")


@query("select lpad(o_orderkey::varchar, 12, '0') as unit_id, (row_number() over (partition by o_orderpriority order by o_orderkey) - 1)::int as level from orders")
def order_chain_levels(spark, sf_dir):
    """Every order calls the one before it of its priority, and the first of all: five chains as deep as the table is long."""
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("unit_id"))
    own = Window.partitionBy("o_orderpriority")
    orders = orders.select("unit_id", F.lag("unit_id").over(own.orderBy("unit_id")).alias("before"), F.min("unit_id").over(own).alias("first"))
    calls = orders.select("unit_id", F.explode(F.array_distinct(F.array("before", "first"))).alias("callee")).filter("callee is not null and callee <> unit_id")
    return graph.unit_levels(orders.select("unit_id"), calls)


METHOD = "'m' || (l_partkey % 60)"
SUPPLIED = f"""
supplied as (select distinct 's' || l_suppkey as type_id, {METHOD} as method from lineitem where l_quantity < 4),
asked as (select distinct 'c' || o_custkey as interface, {METHOD} as method from lineitem join orders on o_orderkey = l_orderkey where l_quantity > 45),
implement as (
  select interface, type_id from (select interface, count(*) as size from asked group by 1) join (select interface, type_id, count(*) as met from asked join supplied using (method) group by 1, 2) using (interface) where met = size)
"""


def supplied_types(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as types, with what they sell little of as methods; customers as interfaces, with what they buy much of."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("type_id"), F.expr(METHOD).alias("method"))
    methods = lines.filter("l_quantity < 4").select("type_id", "method").distinct().withColumn("fn_id", F.concat_ws(".", "type_id", "method"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("interface"))
    return methods, lines.filter("l_quantity > 45").join(orders, "l_orderkey").select("interface", "method").distinct()


@query(f"with {SUPPLIED} select interface, type_id from implement")
def implementations(spark, sf_dir):
    return hierarchy.implementations(*supplied_types(spark, sf_dir))


@query(f"""
with {SUPPLIED},
calls as (select 'n' || c_nationkey as caller, 'c' || o_custkey as interface, {METHOD} as method, min(o_orderkey) as ord from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey where l_quantity > 42 group by 1, 2, 3)
select caller, type_id || '.' || calls.method as callee, min(ord) as ord from calls join asked using (interface, method) join implement using (interface) group by 1, 2""")
def interface_calls(spark, sf_dir):
    """A nation calls what its customers buy; of the interface's methods only those that it buys much of."""
    methods, interfaces = supplied_types(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 42").select(F.col("l_orderkey").alias("o_orderkey"), F.expr(METHOD).alias("method"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    calls = lines.join(orders, "o_orderkey").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("caller"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("interface"), "method", F.col("o_orderkey").alias("ord"))
    return hierarchy.interface_calls(calls, methods, interfaces)


@query("select event_type, count(*)::bigint as n, min(user_id) as least, sum(event_id % 7)::bigint as total from events join (select distinct event_type from events where value >= 99) using (event_type) group by 1")
def hot_references(spark, sf_dir):
    """Few types of events in many rows: the join is split from 500 rows a key on."""
    events = table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", "value")
    targets = events.filter("value >= 99").select("event_type").distinct()
    both = split_join(events, targets, ["event_type"], most=500)
    return both.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("user_id").alias("least"), F.sum(F.col("event_id") % 7).alias("total"))


@query("""
with defs as (
  select o_orderkey as start_line, o_orderkey + case when o_orderkey % 1000 < 4 then 20000 when o_orderkey % 100 < 4 then 700 else 6 end as end_line from orders where o_orderkey % 5 = 0)
select l_returnflag as doc, start_line::int as start_line, count(*)::bigint as n_refs, max(l_orderkey)::int as last_ref from lineitem join defs on start_line <= l_orderkey and l_orderkey < end_line where l_linenumber = 1 group by 1, 2""")
def nested_containment(spark, sf_dir):
    """Three long documents, one for each flag: orders begin short, long and very long ranges in each, lines refer to what they lie in."""
    refs = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_returnflag").alias("doc"), F.col("l_orderkey").cast("int").alias("line"), F.lit(0).alias("char"))
    length = F.expr("case when o_orderkey % 1000 < 4 then 20000 when o_orderkey % 100 < 4 then 700 else 6 end")
    spans = table(spark, sf_dir, "orders").filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").cast("int").alias("start_line"), F.lit(0).alias("start_char"), (F.col("o_orderkey") + length).cast("int").alias("end_line"), F.lit(0).alias("end_char"))
    defs = spans.crossJoin(F.broadcast(refs.select("doc").distinct()))
    return ranges.contained(refs, defs).groupBy("doc", "start_line").agg(F.count(F.lit(1)).alias("n_refs"), F.max("line").alias("last_ref"))


@query("""
select doc_id, regexp_replace(array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)), '\\n+$', '') as body
from documents where len(string_split(text, chr(10))) > 1""")
def doc_lines_slice(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.slice_lines(F.col("text"), F.lit(1), F.lit(3), F.lit(1)).alias("body")).filter("body is not null")


DEFS = """
with l as (select doc_id as doc, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10)))))::int as no from documents),
defs as (select doc, no as start_line, coalesce(lead(no) over (partition by doc order by no), {tail})::int as end_line from l where no % 5 = 0)
"""


def doc_lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("line", "body"))


def doc_ranges(spark, sf_dir, last_span=None) -> DataFrame:
    none = F.lit(None).cast("int")
    defs = doc_lines(spark, sf_dir).filter("line % 5 = 0").select("doc", F.concat(F.lit("s"), "line").alias("symbol"), F.col("line").alias("ord"), F.col("line").alias("start_line"), F.lit(0).alias("start_char"), none.alias("end_line"), none.alias("end_char"))
    return ranges.definition_ranges(defs, last_span)


@query(DEFS.format(tail=2147483647) + "select doc, start_line, end_line from defs")
def def_ranges(spark, sf_dir):
    return doc_ranges(spark, sf_dir).select("doc", "start_line", "end_line")


@query(DEFS.format(tail="no + 200") + "select doc, start_line, end_line from defs")
def def_ranges_types(spark, sf_dir):
    return doc_ranges(spark, sf_dir, 200).select("doc", "start_line", "end_line")


@query(DEFS.format(tail=2147483647) + """
select l.doc, defs.start_line, count(*)::bigint as n_refs, min(l.no)::int as first_ref from l join defs on defs.doc = l.doc and defs.start_line <= l.no and l.no < defs.end_line
where l.line like '%e%' and l.no <> defs.start_line group by 1, 2""")
def containment_edges(spark, sf_dir):
    refs = doc_lines(spark, sf_dir).filter(F.contains("body", F.lit("e"))).select("doc", "line", F.lit(0).alias("char"))
    edges = ranges.contained(refs, doc_ranges(spark, sf_dir)).filter("line <> start_line")
    return edges.groupBy("doc", "start_line").agg(F.count(F.lit(1)).alias("n_refs"), F.min("line").alias("first_ref"))


@query("""
with s as (select user_id, epoch_us(ts) as start, coalesce(lead(epoch_us(ts)) over (partition by user_id order by ts, event_id), 9223372036854775807) as stop from events where event_type = 'signup')
select e.user_id, s.start, count(*)::bigint as n from events e join s on s.user_id = e.user_id and s.start <= epoch_us(e.ts) and epoch_us(e.ts) < s.stop group by 1, 2""")
def event_window_containment(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    # ranges that end at the next start hold a point in the last one that starts before it: a running window, no join
    starts = F.when(F.col("event_type") == "signup", F.col("at"))
    held = events.withColumn("start", F.max(starts).over(Window.partitionBy("user_id").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return held.filter("start is not null").groupBy("user_id", "start").agg(F.count(F.lit(1)).alias("n"))


@query("select min(doc_id) as doc_id, sha256(text) as text_sha256 from documents group by text")
def first_wins_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    return lookups.first_of(docs, ["text_sha256"], ["doc_id"], ["doc_id"])


@query("select doc_id from (select doc_id, row_number() over (partition by text order by doc_id) as k from documents) where k > 1")
def dup_warnings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return ranges.repeats(docs, ["h"], [F.col("doc_id")]).select("doc_id")


@query("select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by user_id")
def last_wins(spark, sf_dir):
    return lookups.last_of(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], ["event_id", "event_type"])


@query("select source, lang from (select source, lang, row_number() over (partition by source order by count(*) desc, lang) as k from documents group by source, lang) where k = 1")
def majority_language(spark, sf_dir):
    return ranges.majority(table(spark, sf_dir, "documents"), "source", "lang")


@query("select n_name, string_agg(c_name, ',' order by c_custkey) as methods from customer join nation on n_nationkey = c_nationkey group by n_name")
def method_type_link(spark, sf_dir):
    named = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    return lookups.listed(named, "n_name", ["c_custkey"], "c_name", "methods").withColumn("methods", F.array_join("methods", ","))


@query("select a.s_suppkey, count(b.s_suppkey)::bigint as n_siblings, coalesce(min(b.s_name), '') as first_sibling from supplier a left join supplier b on b.s_nationkey = a.s_nationkey and b.s_suppkey <> a.s_suppkey group by 1")
def sibling_methods(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier")
    groups = suppliers.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("s_suppkey", "s_name"), F.struct("s_name", "s_suppkey")).alias("one"), F.min("s_name").alias("lo"))
    others = suppliers.join(groups.select("s_nationkey", F.col("one.s_suppkey").alias("one"), "n", "lo"), "s_nationkey")
    second = others.filter("s_suppkey <> one").groupBy("s_nationkey").agg(F.min("s_name").alias("next"))
    return others.join(second, "s_nationkey", "left").select("s_suppkey", (F.col("n") - 1).alias("n_siblings"), F.coalesce(F.when(F.col("s_suppkey") == F.col("one"), F.col("next")).otherwise(F.col("lo")), F.lit("")).alias("first_sibling"))


@query("select a.o_orderkey, count(*)::bigint as n_siblings, min(b.o_orderkey) as least from orders a join orders b on b.o_custkey = a.o_custkey and b.o_orderkey <> a.o_orderkey group by 1")
def order_siblings(spark, sf_dir):
    """Orders as units whose type is their customer: the customer's other orders."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("member"))
    others = lookups.siblings(orders, "o_custkey", "member", orders.withColumn("o_orderkey", F.col("member")), "o_orderkey")
    return others.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_siblings"), F.min("member").alias("least"))


@query("select distinct l_suppkey from lineitem where l_suppkey not in (select s_suppkey from supplier join nation on n_nationkey = s_nationkey where n_regionkey = 3)")
def external_callees(spark, sf_dir):
    internal = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation").filter("n_regionkey = 3")), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, sf_dir, "lineitem").select("l_suppkey").distinct().join(internal, "l_suppkey", "left_anti")


@query("select page_id, regexp_replace(url, '^[a-z]+://', '') as path from pages where regexp_matches(regexp_replace(url, '^[a-z]+://', ''), '^[^/]*/[^/]*/[^/]*$') or regexp_matches(regexp_replace(url, '^[a-z]+://', ''), '^[^/]*\\.com/[^/]*$')")
def glob_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    return pages.filter(T.matches_any(F.col("path"), ["*/*/*", "*.com/*"]))


@query("select p_partkey, case when p_type like 'PROMO%' or p_type like 'STANDARD%' then 'function' when p_type like 'ECONOMY%' or p_type like 'SMALL%' then 'type' end as class from part")
def classify(spark, sf_dir):
    kinds = F.create_map(*[F.lit(x) for x in ("PROMO", "Function", "STANDARD", "Method", "ECONOMY", "Class", "SMALL", "Struct")])
    kind = F.coalesce(F.element_at(kinds, F.substring_index("p_type", " ", 1)), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", T.symbol_class(kind, F.lit("Term")).alias("class"))


@query("select p_partkey, case when p_size % 2 = 0 then p_brand || '.(' || p_type || ').' || p_name else p_brand || '.' || p_name end || case when p_size % 3 = 0 then '(+1)' else '' end as fn_id from part")
def function_id(spark, sf_dir):
    receiver = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", T.function_id(F.col("p_brand"), F.col("p_name"), receiver, F.when(F.col("p_size") % 3 == 0, "+1").otherwise("")).alias("fn_id"))


@query("select page_id, regexp_replace(url, '^https?://', '/') as path from pages")
def uri_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_file_uri(F.regexp_replace("url", "^https?://", "file:///")).alias("path"))


@query("select doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as line_sha256 from documents")
def collapse_ws(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.collapse_space(F.col("text")), 256).alias("line_sha256"))


@query("select doc_id, sha256(source || lang || text) as cache_key from documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("source"), F.col("lang"), F.col("text")).alias("cache_key"))


@query("select case when l.doc_id is null then 'miss' else 'hit' end as state, count(*)::bigint as n from documents d left join labels l on l.doc_id = d.doc_id group by 1")
def cache_split(spark, sf_dir):
    cache = table(spark, sf_dir, "labels").select("doc_id").withColumn("hit", F.lit(1))
    both = lookups.cached(table(spark, sf_dir, "documents").select("doc_id"), cache, "doc_id", "hit")
    return both.groupBy(F.when(F.col("hit").isNull(), "miss").otherwise("hit").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def resume_remaining(spark, sf_dir):
    return lookups.remaining(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("select n_nationkey, pass, ord from nation, (values ('baseline', 1), ('security', 3)) as p(pass, ord)")
def units_x_passes(spark, sf_dir):
    passes = spark.createDataFrame([("summary", 0, True), ("baseline", 1, True), ("correctness", 2, False), ("security", 3, True)], "pass string, ord int, enabled boolean")
    return lookups.with_passes(table(spark, sf_dir, "nation").select("n_nationkey"), passes)


@query("select event_id, json_extract(props, '$.k')::bigint as k from events")
def issue_decode(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) + 1 as no, regexp_replace(chr(9) || string_split(text, chr(10))[2][1:4] || chr(10), '^[\\s\\x{0085}\\x{00A0}]+|[\\s\\x{0085}\\x{00A0}]+$', '', 'g') as code from documents where len(string_split(text, chr(10))) > 1)
select doc_id, case when min(code) = '' then 0 else coalesce(arg_min(no, abs(no - 3) * 100000 + no) filter (where contains(line, code)), 3) end::int as line from l group by doc_id""")
def locate_snippet(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("second", F.get(F.split("text", "\n", -1), F.lit(1))).filter("second is not null")
    return docs.select("doc_id", T.locate_snippet(F.col("text"), F.concat(F.lit("\t"), F.substring("second", 1, 4), F.lit("\n")), F.lit(3)).alias("line"))


SEVERITY = "case when value < 20 then 'critical' when value < 40 then 'high' when value < 60 then 'medium' when value < 80 then 'low' else 'info' end"


@query(f"select {SEVERITY} as severity, count(*)::bigint as n, count(distinct user_id)::bigint as n_units from events group by 1")
def severity_counts(spark, sf_dir):
    return lookups.issue_counts(table(spark, sf_dir, "events").select("user_id", F.expr(SEVERITY).alias("severity")), "severity", unit="user_id")


@query("select user_id, row_number() over (order by min(epoch_us(ts)), user_id)::int as place from events where value < 20 group by user_id")
def critical_units(spark, sf_dir):
    issues = table(spark, sf_dir, "events").select("user_id", "ts", F.expr(SEVERITY).alias("severity"))
    return lookups.placed(lookups.critical_units(issues, "user_id", F.col("ts")), ["first", "user_id"]).select("user_id", F.col("place").cast("int").alias("place"))


@query(f"select distinct event_type as rule, case {SEVERITY} when 'critical' then 'error' when 'high' then 'error' when 'medium' then 'warning' else 'note' end as level from events")
def sarif_levels(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("rule"), T.sarif_level(F.expr(SEVERITY)).alias("level")).distinct()


# documents as the files of a code index: in every block of ten lines, line 0 defines a type, line 3 a function and line 5 a method of
# the block's type. Lines with an e refer to the function of the block that began at the last line 3, lines 4 with an a to its
# method, lines 9 to what other packages define.


def doc_index(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.lit("i").alias("path"), F.col("doc_id").cast("int").alias("ord"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("doc"), F.col("lang").alias("language"), "text", F.lit("").alias("root"), "source", "doc_id")
    split = F.split("text", "\n", -1)
    # cut and counted before they are a row each: beside the explode it would be done again for every line
    held = docs.select("path", "doc", F.col("ord").alias("doc_ord"), split.alias("lines"), F.size(split).alias("n_lines"), F.concat(F.lit("synth m "), "source", F.lit(" v d"), F.col("doc_id").cast("string"), F.lit("/")).alias("head"))
    lines = held.select("path", "doc", "doc_ord", "n_lines", "head", F.posexplode("lines").alias("line", "body"))
    lines = lines.withColumn("at", F.col("line") % 10).withColumn("block", F.col("line") - F.col("line") % 10)
    number = lambda c: c.cast("string")
    typed = F.concat("head", F.lit("T"), number(F.col("block")), F.lit("#"))
    function = lambda block: F.concat("head", F.lit("f"), number(block), F.lit("()."))
    method = F.concat(typed, F.lit("m"), number(F.col("block")), F.lit("()."))
    defined = F.when(F.col("at") == 0, typed).when(F.col("at") == 3, function(F.col("block"))).when(F.col("at") == 5, method)
    kind = F.when(F.col("at") == 0, F.when(F.col("block") % 20 == 0, "Struct").otherwise("TypeAlias")).when(F.col("at") == 5, "Method").otherwise("")
    symbols = lines.filter(defined.isNotNull()).select("path", "doc", "doc_ord", F.col("line").alias("ord"), defined.alias("symbol"), kind.alias("kind"), F.lit("").alias("display"), F.concat(F.lit("sig "), number(F.col("line"))).alias("signature"), F.array(F.lit("doc"), number(F.col("line"))).alias("documentation"))
    none = F.array().cast("array<int>")
    place = F.array(F.col("line"), F.lit(0), F.lit(1))
    last = F.when(F.col("at") >= 3, F.col("block")).otherwise(F.col("block") - 10)
    target = F.when(F.col("at") == 9, F.concat(F.lit("other m std v lib/x"), number(F.col("block") % 30), F.lit("()."))).when((F.col("at") == 4) & F.contains("body", F.lit("a")) & (F.col("n_lines") > F.col("block") + 5), method).when(F.contains("body", F.lit("e")) & (last >= 0), function(last))
    occurrence = lambda symbol, roles, ord_: lines.filter(symbol.isNotNull()).select("path", "doc", "doc_ord", ord_.alias("ord"), symbol.alias("symbol"), F.lit(roles).alias("roles"), place.alias("range"), none.alias("enclosing"))
    uses = occurrence(defined, 1, F.col("line") * 2).unionByName(occurrence(target, 0, F.col("line") * 2 + 1))
    told = spark.createDataFrame([("i", 0, "other m std v lib/x0().", "Function", "first", "sig a", ["doc a"]), ("i", 1, "other m std v lib/x0().", "Function", "second", "sig b", ["doc b"]), ("i", 2, "other m std v lib/x20().", "Class", "", "", [])], "path string, ord int, symbol string, kind string, display string, signature string, documentation array<string>")
    return {"documents": docs.drop("source", "doc_id"), "symbols": symbols, "occurrences": uses, "external_symbols": told}


def doc_units(spark: SparkSession, sf_dir: str) -> Extracted:
    return extract_index(spark, doc_index(spark, sf_dir))


INDEX = """
with l as (select doc_id, source, source || '/d' || doc_id as package, string_split(text, chr(10)) as ls, unnest(string_split(text, chr(10))) as body, unnest(range(len(string_split(text, chr(10)))))::int as no from documents),
b as (select *, no % 10 as spot, no - no % 10 as block from l),
fns as (
  select *, case when spot = 3 then package || '.f' || block else package || '.(T' || block || ').m' || block end as fn_id, case when spot = 3 then 'f' || block else 'm' || block end as name,
    coalesce(lead(no) over (partition by doc_id order by no), 2147483647) as stop from b where spot in (3, 5)),
types as (select *, package || '.T' || block as type_id, coalesce(lead(no) over (partition by doc_id order by no), no + 200) as stop from b where spot = 0),
refs as (
  select doc_id, no, package, case when spot = 9 then 'scip:other m std v lib/x' || (block % 30) || '().' when spot = 4 and contains(body, 'a') and len(ls) > block + 5 then package || '.(T' || block || ').m' || block
    when contains(body, 'e') and (spot >= 3 or block > 0) then package || '.f' || (case when spot >= 3 then block else block - 10 end) end as callee from b),
known as (select r.* from refs r left join fns f on f.fn_id = r.callee where f.fn_id is not null or (r.callee like 'scip:%' and r.callee not like '%/x20().')),
calls as (select f.doc_id, f.fn_id as caller, r.callee, min(r.no) as first_at from known r join fns f on f.doc_id = r.doc_id and f.no <= r.no and r.no < f.stop where f.fn_id <> r.callee group by 1, 2, 3),
edges as (select doc_id, caller, callee, row_number() over (partition by caller order by first_at) as ord from calls),
pairs as (select x.caller, x.callee from edges x join edges y on y.caller = x.callee and y.callee = x.caller),
scc as (select fn_id, least(fn_id, coalesce(min(callee), fn_id)) as scc from fns left join pairs on caller = fn_id group by fn_id),
named as (select scc, string_agg(fn_id, '+' order by fn_id) as unit_id from scc group by scc),
outer_calls as (select s.scc, e.callee, min(struct_pack(a := e.caller, b := e.ord)) as first_call from edges e join scc s on s.fn_id = e.caller where e.callee like 'scip:%' group by 1, 2),
inner_calls as (
  select a.scc, c.scc as callee_scc, min(struct_pack(a := e.caller, b := e.ord)) as first_call from edges e join scc a on a.fn_id = e.caller join scc c on c.fn_id = e.callee where a.scc <> c.scc group by 1, 2),
units as (
  select n.unit_id, n.scc, coalesce((select string_agg(m.unit_id, ',' order by first_call) from inner_calls i join named m on m.scc = i.callee_scc where i.scc = n.scc), '') as callees,
    coalesce((select string_agg(callee, ',' order by first_call) from outer_calls o where o.scc = n.scc), '') as externals from named n)
"""
BODY = "sha256(regexp_replace(array_to_string(list_slice(ls, no + 1, stop), chr(10)), '\\n+$', ''))"


@query(INDEX + f"select fn_id, package, name, case when spot = 5 then 'T' || block else '' end as receiver, case when spot = 5 then package || '.T' || block else '' end as receiver_type, 'sig ' || no as signature, 'doc' || chr(10) || chr(10) || no as doc, (no + 1)::bigint as line, {BODY} as body_sha256 from fns")
def index_functions(spark, sf_dir):
    return doc_units(spark, sf_dir).functions.select("fn_id", "package", "name", "receiver", "receiver_type", "signature", "doc", F.col("position.Line").alias("line"), F.sha2("body", 256).alias("body_sha256"))


@query(INDEX + f"select t.type_id, case when t.block % 20 = 0 then 'struct' else 'type' end as kind, t.package, 'T' || t.block as name, coalesce(f.fn_id, '') as methods, t.body_sha256 from (select *, {BODY} as body_sha256 from types) t left join fns f on f.doc_id = t.doc_id and f.block = t.block and f.spot = 5")
def index_types(spark, sf_dir):
    return doc_units(spark, sf_dir).types.select("type_id", "kind", "package", "name", F.array_join("methods", ",").alias("methods"), F.sha2("body", 256).alias("body_sha256"))


@query(INDEX + "select caller, callee, ord::bigint as ord from edges")
def index_edges(spark, sf_dir):
    return doc_units(spark, sf_dir).edges.select("caller", "callee", "ord")


@query(INDEX + "select distinct callee as ext_id, 'std/lib' as package, case when callee like '%/x0().' then 'second' else replace(replace(callee, 'scip:other m std v lib/', ''), '().', '') end as name, case when callee like '%/x0().' then 'sig b' else '' end as signature, case when callee like '%/x0().' then 'doc b' else '' end as doc from known where callee like 'scip:%'")
def index_externals(spark, sf_dir):
    return doc_units(spark, sf_dir).externals.select("ext_id", "package", "name", "signature", "doc")


@query(INDEX + "select unit_id, callees, externals from units")
def index_units(spark, sf_dir):
    return doc_units(spark, sf_dir).units.select("unit_id", F.array_join("callees", ",").alias("callees"), F.array_join("externals", ",").alias("externals"))


def doc_review(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A review with a client that finds one issue at the first function's line 2 in every unit and pass."""
    issue = '{"issues": [{"function": "", "line": 2, "code": "", "severity": "low", "message": "m"}]}'
    summary = '{"purpose": "p", "behavior": "", "invariants": [], "security": []}'
    client = KeyedClient({}, {"summary": summary, "issues": issue})
    return review(spark, doc_units(spark, sf_dir), client, Config(passes=[Pass("security"), Pass("summary"), Pass("baseline", enabled=False)]))


@query(INDEX + "select u.unit_id, case when u.callees = '' then 0 else 1 end::int as level, 'p' as purpose, count(*)::bigint as n_functions from units u join scc s on s.scc = u.scc group by all")
def review_units(spark, sf_dir):
    return doc_review(spark, sf_dir)[0].select("unit_id", F.col("ordinal").alias("level"), "purpose", F.size("functions").cast("long").alias("n_functions"))


@query(INDEX + "select u.unit_id, 'security' as category, 'low' as severity, (min_by(f.no, f.fn_id) + 2)::bigint as line from units u join scc s on s.scc = u.scc join fns f on f.fn_id = s.fn_id group by 1")
def review_issues(spark, sf_dir):
    return doc_review(spark, sf_dir)[1].select("unit_id", "category", "severity", F.col("position.Line").alias("line"))


class CountingClient:
    """Answers by what a prompt holds: purposes add up those of callees, 100 for each function from outside, 10,000 for the receiver's
    type with its one method; issues tell the sum of all purposes that the prompt shows."""

    def complete(self, request: dict) -> str:
        text = request["prompt"]
        told, types = (sum(map(int, re.findall(f"^Purpose: {c}([0-9]+)$", text, re.M))) for c in "pt")
        if request["schema"]["name"] == "issues":
            return json.dumps({"issues": [{"function": "", "line": 0, "code": "", "severity": "info", "message": f"m{told}"}]})
        if request["pass"] == "type_summary":
            return json.dumps({"purpose": f"t{len(re.findall('^- `sig [0-9]+`', text, re.M))}"})
        return json.dumps({"purpose": f"p{1 + told + 100 * text.count('from outside of this project') + 10_000 * types}"})


@query(INDEX + """,
own as (
  select u.unit_id, u.scc, 1 + 100 * (case when externals = '' then 0 else len(string_split(externals, ',')) end) + case when count(*) = 1 and min(f.spot) = 5 then 10000 else 0 end as n
  from units u join scc s on s.scc = u.scc join fns f on f.fn_id = s.fn_id group by u.unit_id, u.scc, externals),
deep as (select a.unit_id, a.n, coalesce(sum(b.n), 0)::bigint as below from own a left join inner_calls i on i.scc = a.scc left join own b on b.scc = i.callee_scc group by 1, 2)
select unit_id, 'p' || (n + below) as purpose, 'm' || (n + 2 * below) as message from deep""")
def review_contexts(spark, sf_dir):
    units, issues = review(spark, doc_units(spark, sf_dir), CountingClient(), Config(passes=[Pass("summary"), Pass("security")]))
    return units.select("unit_id", "purpose").join(issues.select("unit_id", "message"), "unit_id")


LABELS = "case lang when 'de' then 'CPP' when 'en' then 'rust' when 'es' then '' else 'Zig' end"
SUFFIX = "case when doc_id % 3 = 0 then 'ts' when doc_id % 3 = 1 then 'PY' else 'none' end"


@query(f"""
with f as (select source || '/' || lang || (case when lang = 'es' then (doc_id % 2)::varchar else '' end) as project, doc_id, {LABELS} as label, {SUFFIX} as suffix, lang = 'es' and doc_id % 2 = 1 and doc_id % 5 = 0 as schemed from documents),
labelled as (select project, label, row_number() over (partition by project order by count(*) desc, label) as k from f where label <> '' group by project, label),
named as (select project, case suffix when 'ts' then 'TypeScript' else 'Python' end as language, row_number() over (partition by project order by count(*) desc, suffix = 'ts') as k from f where suffix <> 'none' group by project, suffix)
select distinct f.project, coalesce(case l.label when 'CPP' then 'C++' when 'rust' then 'Rust' else l.label end, s.language, n.language) as language
from f left join labelled l on l.project = f.project and l.k = 1 left join (select distinct project, 'Go' as language from f where schemed) s on s.project = f.project left join named n on n.project = f.project and n.k = 1
where coalesce(l.label, s.language, n.language) is not null""")
def language_choice(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr("source || '/' || lang || (case when lang = 'es' then cast(doc_id % 2 as string) else '' end)").alias("project"), F.expr(LABELS).alias("language"), F.expr(f"doc_id || '.' || {SUFFIX}").alias("path"), "lang")
    schemes = docs.filter("lang = 'es' and doc_id % 2 = 1 and doc_id % 5 = 0").select("project", F.col("doc_id").alias("at"), F.lit("scip-go").alias("scheme"))
    return languages.pick(docs, schemes, "project")


CALLS = "select 'p' || (l_partkey % 7) || '.f' || (l_partkey % 50) as caller, 'p' || (l_suppkey % 11) || case when l_suppkey % 2 = 0 then '.(*R).m' else '.g' end || (l_suppkey % 13) as callee, min(l_orderkey) as ord from lineitem group by 1, 2"


@query(f"""
with calls as ({CALLS}), found as (select distinct callee, replace(split_part(callee, '.', 1), 'p', '')::int as n from calls)
select callee as ext_id, 'p' || n as package, split_part(callee, '.', -1) as name, 'sig ' || split_part(callee, '.', -1) as signature from found where n >= 7 and n <> 9 and split_part(callee, '.', -1) not in ('m4', 'g5')""")
def package_externals(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    calls = items.groupBy(F.expr("'p' || (l_partkey % 7) || '.f' || (l_partkey % 50)").alias("caller"), F.expr("'p' || (l_suppkey % 11) || case when l_suppkey % 2 = 0 then '.(*R).m' else '.g' end || (l_suppkey % 13)").alias("callee")).agg(F.min("l_orderkey").alias("ord"))
    own = spark.range(7).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("package"))
    imports = spark.createDataFrame([("p0", "p7"), ("p7", "p8"), ("p8", "p10"), ("p10", "p0"), ("p9", "p8")], "package string, import string")  # nothing imports p9
    names = spark.range(11).crossJoin(spark.range(13).withColumnRenamed("id", "k"))
    symbols = names.select(F.expr("'p' || id").alias("package"), F.explode(F.array(*[F.struct(F.expr(f"'{c}' || k").alias("name"), F.lit(r).alias("receiver")) for c, r in (("m", "R"), ("g", ""))])).alias("x")).select("package", "x.*")
    symbols = symbols.withColumn("signature", F.when(F.col("name").isin("m4", "g5"), "").otherwise(F.concat(F.lit("sig "), "name"))).withColumn("doc", F.lit("d"))
    return external_functions(calls, own, symbols, imports).drop("doc")
