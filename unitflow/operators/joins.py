"""Joins whose left side may hold a few keys in most of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitflow.functions.tables import written

#: Rows of one key that one task may take.
MOST = 200_000
#: At most so many keys are split, so that their list can be broadcast: on larger tables a key must hold more rows for that.
HOT_KEYS = 50_000


def hot_keys(left: DataFrame, on: list[str], most: int = MOST) -> tuple[DataFrame, int] | None:
    """The keys with more than `most` rows and how many parts each needs (_copies), counted by partial aggregates; None where there are
    none. Of n rows at most n / most keys can be that frequent. Rows are counted by a hash of the key first, and by the key itself only
    where a hash has that many, so that a table of rare keys isn't shuffled."""
    total = left.count()
    if total <= most:
        return None
    most = max(most, -(-total // HOT_KEYS))
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in on]), F.lit(max(1024, 8 * total // most)))
    parts = written(left.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select("_part"))
    if parts.isEmpty():
        return None
    some = left.select(*[F.col(f"`{c}`") for c in on], part.alias("_part")).join(F.broadcast(parts), "_part", "left_semi")
    counts = some.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most)
    found = written(counts.select(*on, F.ceil(F.col("_n") / most).cast("int").alias("_copies")))
    return None if found.isEmpty() else (found, most)


def split_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", most: int = MOST) -> DataFrame:
    """left join right (inner, left, left_semi or left_anti) on equally named columns. Keys with more than `most` rows on the left are
    split by their weight: their rows go to n / most tasks by a hash of the whole row, and the right side's rows to each of these.

    The left side is read twice, so it should be a table. Null keys match nothing, as in any join; columns beginning with _salt or
    _copies are taken."""
    hot = hot_keys(left, on, most)
    if hot is None:
        return left.join(right, on, how)
    hot = F.broadcast(hot[0])
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.coalesce("_copies", F.lit(1))).cast("int")
    left = left.join(hot, on, "left").withColumn("_salt", salt).drop("_copies")
    right = right.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))).drop("_copies")
    return left.join(right, [*on, "_salt"], how).drop("_salt")
