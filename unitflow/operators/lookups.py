"""Joins and collections by key that extraction, review and reports share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def listed(rows: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """Per key its values in order, as an array."""
    held = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_value"))))
    return rows.groupBy(key).agg(F.transform(held, lambda x: x["_value"]).alias(name))


def first_of(rows: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Of each key's rows the values of the first, by partial aggregates: a hot key costs one row a task."""
    return _one(rows, key, order, values, F.min_by)


def last_of(rows: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Of each key's rows the values of the last."""
    return _one(rows, key, order, values, F.max_by)


def _one(rows, key, order, values, pick) -> DataFrame:
    best = rows.groupBy(*key).agg(pick(F.struct(*[F.col(v).alias(f"v{k}") for k, v in enumerate(values)]), F.struct(*order)).alias("_best"))
    return best.select(*key, *[F.col(f"_best.v{k}").alias(v) for k, v in enumerate(values)])


def siblings(members: DataFrame, owner: str, member: str, units: DataFrame, unit: str) -> DataFrame:
    """units (unit, owner, member: one row a member) to the owner's other members: unit and all columns of members (owner, member,
    ...), without those that the unit has itself."""
    whole = units.select(unit, owner).distinct().join(members, owner)
    return whole.join(units.select(unit, member), [unit, member], "left_anti")


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not done yet."""
    return rows.join(done.select(key), key, "left_anti")


def cached(rows: DataFrame, cache: DataFrame, key: str, payload: str) -> DataFrame:
    """rows with the cache's payload (null: a miss); of several payloads of a key the greatest."""
    return rows.join(cache.groupBy(key).agg(F.max(payload).alias(payload)), key, "left")


def with_passes(units: DataFrame, passes: DataFrame) -> DataFrame:
    """Every unit with every enabled pass but summary; passes (pass, ord, enabled) has a row a configured pass."""
    return units.crossJoin(F.broadcast(passes.filter("enabled and pass <> 'summary'").select("pass", "ord")))


def issue_counts(issues: DataFrame, *by: str, unit: str = "unit_id") -> DataFrame:
    """Issues (n) and their units (n_units) by severity, category or what is asked for."""
    return issues.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(unit).alias("n_units"))


def critical_units(issues: DataFrame, unit: str, order: Column) -> DataFrame:
    """Units with a critical issue and the least of `order` over these issues: where the unit stands in the report."""
    return issues.filter("severity = 'critical'").groupBy(unit).agg(F.min(order).alias("first"))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with place, 1 and on, by order (which has no ties). Rows are sorted over range partitions, and only a count a partition
    comes to the driver."""
    from unitflow.functions.tables import written

    sized = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    parts = sized.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("_from")).orderBy("_part").collect()
    before, starts = 0, []
    for p in parts:
        starts.append((p["_part"], before - p["_from"]))
        before += p["n"]
    shift = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part int, _shift long"))
    return sized.join(shift, "_part").withColumn("place", F.col("_at") + F.col("_shift") + 1).drop("_part", "_at", "_shift")


def positions(rows: DataFrame, key: list[str], order: list[str], name: str = "ord") -> DataFrame:
    """rows with their position within their key, 0 and on, by order (which has no ties in a key). All rows are sorted together over range
    partitions, and a key's first place is taken off: a key with most of the rows lies over many partitions."""
    from unitflow.operators.joins import split_join

    all_placed = placed(rows, [*key, *order])
    first = all_placed.groupBy(*key).agg(F.min("place").alias("_first"))
    return split_join(all_placed, first, key).withColumn(name, F.col("place") - F.col("_first")).drop("place", "_first")
