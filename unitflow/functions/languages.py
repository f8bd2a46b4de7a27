"""Names of programming languages, by an index's own label, by the scheme of its symbols, or by file suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitflow.operators.ranges import majority

#: Fixed: display name, symbol schemes, labels in lower case, file suffixes.
LANGUAGES = [
    ("Go", ["scip-go"], ["go"], [".go"]),
    ("Rust", ["rust-analyzer"], ["rust"], [".rs"]),
    ("Java", ["scip-java", "semanticdb"], ["java"], [".java"]),
    ("Kotlin", [], ["kotlin"], [".kt", ".kts"]),
    ("Python", ["scip-python"], ["python"], [".py"]),
    ("Ruby", ["scip-ruby"], ["ruby"], [".rb"]),
    ("TypeScript", ["scip-typescript"], ["typescript"], [".ts", ".tsx"]),
    ("JavaScript", [], ["javascript"], [".js", ".jsx"]),
    ("C", [], ["c"], [".c", ".h"]),
    ("C++", ["scip-clang"], ["cpp"], [".cpp", ".cc", ".cxx", ".hpp", ".hxx"]),
    ("C#", [], ["csharp"], []),
    ("Objective-C", [], ["objectivec"], [".m"]),
    ("Objective-C++", [], ["objectivecpp"], [".mm"]),
]


def _lookup(place: int) -> Column:
    return F.create_map(*[F.lit(x) for row in LANGUAGES for handle in row[place] for x in (handle, row[0])])


def display(label: Column) -> Column:
    """The display name of a label in any case; unknown labels as they are."""
    return F.coalesce(F.element_at(_lookup(2), F.lower(label)), label)


def of_scheme(scheme: Column) -> Column:
    return F.element_at(_lookup(1), scheme)


def suffix(path: Column) -> Column:
    """The file name from its last dot on, in lower case; empty without one."""
    return F.lower(F.regexp_extract(path, "(\\.[^./]*)$", 1))


def of_path(path: Column) -> Column:
    return F.element_at(_lookup(3), suffix(path))


def pick(files: DataFrame, symbols: DataFrame, key: str) -> DataFrame:
    """Per key one language at most: the most frequent raw label of files (key, path, language), the smallest on ties; without any
    label that of the first symbol (key, scheme, at: its place) with a known scheme; else the most frequent one by file suffix."""
    labelled = majority(files.filter("language <> ''"), key, "language").select(key, display(F.col("language")).alias("language"), F.lit(0).alias("_turn"))
    known = symbols.select(key, "at", of_scheme(F.col("scheme")).alias("language")).filter("language is not null")
    by_scheme = known.groupBy(key).agg(F.min_by("language", "at").alias("language")).select(key, "language", F.lit(1).alias("_turn"))
    named = files.select(key, of_path(F.col("path")).alias("language")).filter("language is not null")
    by_suffix = majority(named, key, "language").select(key, "language", F.lit(2).alias("_turn"))
    every = labelled.unionByName(by_scheme).unionByName(by_suffix)
    return every.groupBy(key).agg(F.min_by("language", "_turn").alias("language"))
