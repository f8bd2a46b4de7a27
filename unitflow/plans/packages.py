"""Reviews of code that was taken apart elsewhere: tables of functions, types, calls and package symbols instead of an index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unitflow.functions import text as T
from unitflow.functions.tables import written
from unitflow.operators import graph, hierarchy, lookups
from unitflow.plans.extract import Extracted, linked
from unitflow.sources.gosource import go_tables


def called(fn_id: Column, package: Column) -> tuple[Column, Column]:
    """Name and receiver of a function id of a package: package.name or package.(receiver).name."""
    rest = F.substring(fn_id, F.length(package) + 2, F.length(fn_id))
    method = rest.startswith("(") & (F.instr(rest, ").") > 0)
    end = F.instr(rest, ").")
    return F.when(method, F.substring(rest, end + 2, F.length(rest))).otherwise(rest), F.when(method, F.substring(rest, F.lit(2), end - 2)).otherwise("")


def external_functions(calls: DataFrame, packages: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """What is called outside of packages (package), by calls (callee): ext_id, package, name, signature, doc. It is looked up in
    symbols (package, name, receiver, signature, doc) of all packages that imports (package, import) lead to; what is unknown or has
    no signature is left out."""
    ids = calls.select(F.col("callee").alias("ext_id")).distinct().withColumn("package", T.package_of(F.col("ext_id")))
    ids = ids.filter("package <> '' and package <> ext_id").join(packages.select("package").distinct(), "package", "left_anti")
    name, receiver = called(F.col("ext_id"), F.col("package"))
    ids = ids.withColumn("name", name).withColumn("receiver", T.strip_pointer(receiver))
    known = symbols.join(graph.reachable(packages, imports), "package", "left_semi").filter("signature <> ''").withColumn("receiver", T.strip_pointer(F.coalesce("receiver", F.lit(""))))
    known = lookups.last_of(known, ["package", "name", "receiver"], ["signature"], ["signature", "doc"])
    return ids.join(known, ["package", "name", "receiver"]).select("ext_id", "package", "name", "signature", F.coalesce("doc", F.lit("")).alias("doc"))


@dataclass
class Dispatch:
    """interfaces (interface, method) and calls through them (caller, interface, method, ord); methods (fn_id, method) where a method's
    key is more than its name, as with its parameters' types; embeds (type_id, embedded); values (fn_id, signature, used) and calls of
    function values (caller, signature, ord). What is None isn't there."""

    interfaces: DataFrame
    calls: DataFrame
    methods: DataFrame | None = None
    embeds: DataFrame | None = None
    values: DataFrame | None = None
    value_calls: DataFrame | None = None


def dispatched(functions: DataFrame, told: Dispatch) -> DataFrame:
    """functions (fn_id, package, name, receiver, ...) to the edges (caller, callee, ord) of calls whose target depends on a type or a value."""
    own = functions.filter("receiver <> ''").select("fn_id", F.concat("package", F.lit("."), T.strip_pointer(F.col("receiver"))).alias("type_id"), F.col("name").alias("method"))
    if told.methods is not None:
        own = own.drop("method").join(told.methods.select("fn_id", "method"), "fn_id")
    if told.embeds is not None:
        own = hierarchy.method_sets(own, told.embeds)
    edges = hierarchy.interface_calls(told.calls, own, told.interfaces)
    if told.values is not None and told.value_calls is not None:
        edges = edges.unionByName(hierarchy.signature_calls(told.value_calls, told.values))
    return edges.select("caller", "callee", F.col("ord").cast("long").alias("ord"))


def from_tables(functions: DataFrame, types: DataFrame, calls: DataFrame, symbols: DataFrame, imports: DataFrame, language: str = "Go", dispatch: Dispatch | None = None) -> Extracted:
    """functions (ord, package, name, receiver, signature, body, doc, position), types (ord, package, name, kind, signature, body,
    doc, position), calls (caller, callee, ord). A receiver is written with a leading * and type parameters or without; methods are
    linked to the bare type's name, and ids have it as it is written. Of functions or types with one id the last counts. dispatch: what
    is called through interfaces and function values, where that is known; these calls become edges too."""
    spark = functions.sparkSession
    fns = functions.withColumn("receiver", F.coalesce("receiver", F.lit(""))).withColumn("fn_id", T.function_id(F.col("package"), F.col("name"), F.col("receiver"), F.lit("")))
    columns = ["ord", "package", "name", "receiver", "signature", "body", "doc", "position"]
    fns = lookups.last_of(fns, ["fn_id"], ["ord"], columns).withColumn("disambiguator", F.lit(""))
    named = types.withColumn("type_id", F.concat("package", F.lit("."), "name"))
    named = lookups.last_of(named, ["type_id"], ["ord"], ["name", "kind", "package", "signature", "body", "doc", "position"])
    found, linked_types = linked(fns.withColumn("_owner", T.strip_pointer(F.col("receiver"))), named, ["ord", "fn_id"])
    if dispatch:
        calls = calls.select("caller", "callee", "ord").unionByName(dispatched(found, dispatch))
    edges = written(calls.groupBy("caller", "callee").agg(F.min("ord").alias("ord")))
    externals = external_functions(edges, functions.select("package").distinct(), symbols, imports)
    return Extracted(found, linked_types, written(externals), edges, spark.createDataFrame([], "warning string"), spark.createDataFrame([(language,)], "language string"))


def extract_go(spark: SparkSession, root: str, patterns: list[str] | None = None) -> Extracted:
    """The Go packages under root that the patterns mean (none: all)."""
    t = go_tables(spark, root, patterns)
    return from_tables(t["functions"], t["types"], t["calls"], t["symbols"], t["imports"])
