"""What the corpus operators share: the shared folder, written tables, word splitting, Arrow helpers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here, as a character list and as a class for Java's regular expressions.
ASCII_SPACE = " \t\n\x0b\f\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"

#: Per application the folder that stands in where spark.checkpoint.dir is unset in local mode.
_LOCAL: dict[str, str] = {}
#: A table may be broadcast only below this many bytes, by its counted rows and its fixed row width.
BROADCAST_BYTES = 8 << 20


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one in local mode, as in
    tests; on a cluster that is an error, since executors can't read each other's folders."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="unitflow-")
    return _LOCAL[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Removes a table made by written() that nothing will read again."""
    spark = df.sparkSession
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_or_not(table: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The table with a broadcast hint if its counted size is below the limit, else as it is (a shuffled join)."""
    return F.broadcast(table) if table.count() * row_bytes <= limit else table


def join_small(left: DataFrame, right: DataFrame, on: list[str], row_bytes: int, spread: list[str], copies: int = 32, hot_rows: int = 10_000) -> DataFrame:
    """An inner join with a table that is read cheaply and mostly small: broadcast if its counted size is below BROADCAST_BYTES. Else
    it is shuffled, and keys with over hot_rows rows on the left are salted: these rows go to `copies` tasks by the columns `spread`,
    those on the right to all of these. The list of hot keys is broadcast, so where it is too long for that, only hotter ones count."""
    if right.count() * row_bytes <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), on)
    salt, hot, n = unused([*left.columns, *right.columns], "salt", "hot", "n")
    often = written(left.groupBy(*on).agg(F.count(F.lit(1)).alias(n)).filter(F.col(n) > hot_rows), "hot-keys")
    while often.filter(F.col(n) > hot_rows).count() * row_bytes > BROADCAST_BYTES:
        hot_rows *= 4
    often = F.broadcast(often.filter(F.col(n) > hot_rows).select(*on, F.lit(True).alias(hot)))
    left = left.join(often, on, "left").withColumn(salt, F.when(F.col(hot), F.pmod(F.xxhash64(*spread), F.lit(copies))).otherwise(0).cast("int")).drop(hot)
    right = right.join(often, on, "left").withColumn(salt, F.explode(F.when(F.col(hot), F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0))))).drop(hot)
    return left.join(right, [*on, salt]).drop(salt)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores behind them until no column has them in any case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(names: list[str]) -> list[str]:
    """The names as Spark reads them whatever they hold, dots too."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def map_rows(df: DataFrame, columns: list, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.select(*columns).mapInArrow(work, schema)


def map_whole_rows(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], columns: list[tuple[str, str]]) -> DataFrame:
    """work over batches of all columns of df, to the given columns (name, type). Names may hold anything: underway columns go by number."""
    names, out = df.columns, [f"c{k}" for k in range(len(columns))]

    def numbered(batches):
        for batch in work(b.rename_columns(names) for b in batches):
            yield batch.rename_columns(out)

    made = df.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(numbered, ", ".join(f"{n} {kind}" for n, (_, kind) in zip(out, columns)))
    return made.toDF(*[name for name, _ in columns])


def text_bytes(name: str = "text"):
    """A text column as bytes: Python then neither decodes nor encodes it. Null is empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary").alias("text")


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `most` bytes of text, so that memory doesn't follow Arrow's batch size."""
    sizes = pc.binary_length(batch.column(column)).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


class Memo(dict):
    """A bounded memo of a function of a short key; get values with memo[key]. When it is full, its entries become the old
    ones, which are kept until it is full again: what is used stays."""

    def __init__(self, compute: Callable, most: int = 150_000, longest: int = 48):
        super().__init__()
        self.compute, self.most, self.longest, self.old = compute, most, longest, {}

    def __missing__(self, key):
        value = self.old.get(key, self)
        if value is self:
            value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
