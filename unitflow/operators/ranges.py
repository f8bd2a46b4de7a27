"""Definition ranges, and references inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from unitflow.functions.tables import written
from unitflow.operators.joins import MOST, split_join

NO_END = 2147483647


def definition_ranges(definitions: DataFrame, last_span: int | None = None) -> DataFrame:
    """definitions (doc, symbol, ord, start_line, start_char, end_line?, end_char?) to one range a symbol and document.

    The first definition of a symbol counts. Where the end is null, the range reaches to the next start (column 0); the last one
    has no end, or ends last_span lines on."""
    first = definitions.withColumn("_k", F.row_number().over(Window.partitionBy("doc", "symbol").orderBy("ord"))).filter("_k = 1")
    by_start = Window.partitionBy("doc").orderBy("start_line", "start_char", "ord")
    tail = F.lit(NO_END) if last_span is None else F.col("start_line") + last_span
    return first.withColumn("_next", F.lead("start_line").over(by_start)).select(
        "doc",
        "symbol",
        "start_line",
        "start_char",
        F.coalesce("end_line", F.coalesce("_next", tail)).alias("end_line"),
        F.when(F.col("end_line").isNull(), 0).otherwise(F.col("end_char")).alias("end_char"),
    )


#: Lines in a block of the lowest level; a block holds FAN blocks of the level below.
LINES, FAN = 64, 4


def _sequence(start: Column, end: Column) -> Column:
    return F.when(start < end, F.sequence(start, end - 1)).otherwise(F.array().cast("array<bigint>"))


def covering(start: Column, end: Column, lines: int = LINES) -> Column:
    """The blocks (level, block) that lines start to end take up: the largest ones that lie inside, and at most two of the lowest level
    that reach beyond. Their number grows with the logarithm of the range's length."""
    sizes, size = [], lines
    while size <= NO_END:
        sizes.append(size)
        size *= FAN

    def full(size: Column) -> tuple[Column, Column]:
        return F.ceil(start / size), F.floor((end + 1) / size)

    def level(x: Column) -> Column:
        lo, hi = full(x["size"])
        up_lo, up_hi = (c * FAN for c in full(x["size"] * FAN))
        own = F.when(up_lo < up_hi, F.concat(_sequence(lo, up_lo), _sequence(up_hi, hi))).otherwise(_sequence(lo, hi))
        return F.transform(own, lambda b: F.struct(x["level"].alias("level"), b.alias("block")))

    lo, hi = full(F.lit(lines))
    first, last = F.floor(start / lines), F.floor(end / lines)
    edges = F.when(lo < hi, F.concat(_sequence(first, lo), _sequence(hi, last + 1))).otherwise(_sequence(first, last + 1))
    ladder = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(n).cast("long").alias("size")) for k, n in enumerate(sizes)])
    return F.concat(F.flatten(F.transform(ladder, level)), F.transform(edges, lambda b: F.struct(F.lit(0).alias("level"), b.alias("block"))))


def contained(references: DataFrame, ranges: DataFrame, lines: int = LINES, most: int = MOST) -> DataFrame:
    """Every pair of a reference (doc, line, char, ...) and a range of its document that holds it: start <= point < end.

    Ranges are dealt by document and the blocks they take up, references by those of their blocks whose levels their document's ranges
    use. So a range over a whole document of n lines has O(log n) rows, and its block, which may hold most references, is split."""
    last = references.groupBy("doc").agg(F.max("line").alias("_last"))
    held = ranges.join(last, "doc").filter("start_line <= _last")
    end = F.greatest("start_line", F.least("end_line", "_last"))
    spread = written(held.withColumn("_at", F.explode(covering(F.col("start_line"), end, lines))).drop("_last"))
    used = spread.select("doc", "_at.level").distinct().groupBy("doc").agg(F.collect_set("level").alias("_levels"))
    dealt = split_join(references, used, ["doc"], most=most).withColumn("_level", F.explode("_levels")).drop("_levels")
    dealt = written(dealt.withColumn("_block", F.floor(F.col("line") / (lines * F.pow(F.lit(FAN), "_level")))))
    spread = spread.withColumn("_level", F.col("_at.level")).withColumn("_block", F.col("_at.block")).drop("_at")
    point = F.struct("line", "char")
    inside = (F.struct("start_line", "start_char") <= point) & (point < F.struct("end_line", "end_char"))
    return split_join(dealt, spread, ["doc", "_level", "_block"], most=most).filter(inside).drop("_level", "_block")


def first_wins(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return _ranked(rows, key, order).filter("_rank = 1").drop("_rank")


def repeats(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """All rows but the first of each key: the warnings."""
    return _ranked(rows, key, order).filter("_rank > 1").drop("_rank")


def _ranked(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def ordered_distinct(edges: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Per key its distinct values in first-seen order, as an array."""
    first = edges.groupBy(key, value).agg(F.min(order).alias("_at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", value))), lambda x: x[value]).alias(f"{value}s"))


def majority(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the most frequent value, the smallest on ties; partial counts, so a hot key is spread."""
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("_n")).alias("_n"), F.col(value))).alias("_best")).select(key, F.col(f"_best.{value}").alias(value))
