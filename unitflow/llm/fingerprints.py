"""Document fingerprints (native): a homomorphic multiset hash of a text's paragraphs.

Every paragraph (line) is hashed to a wide vector; a text's vector is their sum, word by word, modulo 2^60. So
order doesn't matter, and adding or taking away a paragraph adds or subtracts its vector (combine()). A vector is

    [sentences, 4 words of 60 random bits a paragraph, 60 words of 2 lanes of 30 bits]

The random words make different multisets differ. The lanes hold, for each of 120 random signs, how many of the
paragraphs' sentences have it: signed sums whose cosine estimates the likeness of two texts (standard error
about 0.09). Sentences, not whole paragraphs, carry the signs, so that texts of one paragraph can be alike. Lanes hold
counts below 2^30, which no text that a string can hold reaches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from unitflow.llm.common import small_or_not, written

MODULUS_MASK = (1 << 60) - 1
LANE_BITS = 30
LANES_MASK = 1 + (1 << LANE_BITS)
LANE = (1 << LANE_BITS) - 1
SENTENCES = "\\\\n|(?<=[.!?]) "


def vector(text: str) -> Column:
    """The vector of a text column (not null). Lambda variables bind arrays, so that each is made once."""
    signs = [
        f"get(transform(array(transform(parts, s -> xxhash64({seed}, s))), hs -> transform(sequence(0, {LANE_BITS - 1}), k -> aggregate(hs, 0L, (a, h) -> (a + (shiftright(h, k) & {LANES_MASK}L)) & {MODULUS_MASK}L))), 0)"
        for seed in (11, 12)
    ]
    words = f"get(transform(array(split({text}, '\\\\n', -1)), ps -> transform(sequence(1, 4), seed -> aggregate(ps, 0L, (a, p) -> (a + (xxhash64(seed, p) & {MODULUS_MASK}L)) & {MODULUS_MASK}L))), 0)"
    return F.expr(
        f"get(transform(array(filter(split({text}, '{SENTENCES}', -1), s -> s != '')), parts -> concat(array(cast(size(parts) as bigint)), {words}, {', '.join(signs)})), 0)"
    )


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The vector of the union of two multisets of paragraphs; with sign -1, of the first without the second."""
    if sign > 0:
        return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(MODULUS_MASK)))
    return F.zip_with(a, b, lambda x, y: (x - y + F.lit(1 << 60)).bitwiseAND(F.lit(MODULUS_MASK)))


def as_string(vec: Column) -> Column:
    return F.array_join(F.transform(vec, lambda v: F.lpad(F.hex(v), 15, "0")), "")


def likeness(a: str, b: str) -> Column:
    """0 to 1: the cosine of the signed sums, 1 for equal vectors, 0 where either has no sentence."""

    def dot(x: str, y: str) -> str:
        signed = lambda word, of, i: f"cast(2 * (shiftright({word}, {LANE_BITS * i}) & {LANE}L) - {of}[0] as double)"
        term = " + ".join(f"{signed('u', x, i)} * {signed('v', y, i)}" for i in range(2))
        return f"aggregate(zip_with(slice({x}, 6, {2 * LANE_BITS}), slice({y}, 6, {2 * LANE_BITS}), (u, v) -> {term}), 0D, (s, t) -> s + t)"

    return F.expr(f"case when {a} = {b} then 1D when {a}[0] = 0 or {b}[0] = 0 then 0D else coalesce(greatest(0D, least(1D, ({dot(a, b)}) / nullif(sqrt(({dot(a, a)}) * ({dot(b, b)})), 0D))), 0D) end")


def neighbours(ids: DataFrame) -> DataFrame:
    """Per doc_id (distinct) the one before it in descending order, as prev_id and prev_half; before the first stands
    the last. Range partitions hold contiguous ids; only their last rows, one a partition, meet in one task."""
    order = F.desc_nulls_last("doc_id")
    ranged = written(ids.repartitionByRange(order).withColumn("pid", F.spark_partition_id()), "doc-order")
    last = ranged.groupBy("pid").agg(F.min_by(F.struct("doc_id", "half"), F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"))).alias("last"))
    by_pid = Window.orderBy("pid")
    edge = last.select("pid", F.coalesce(F.lag("last").over(by_pid), F.last("last").over(by_pid.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("edge"))
    before = F.lag(F.struct("doc_id", "half")).over(Window.partitionBy("pid").orderBy(order))
    return (
        ranged.withColumn("before", before)
        .join(small_or_not(edge, 32), "pid")
        .withColumn("before", F.when(F.col("before").isNull(), F.col("edge")).otherwise(F.col("before")))
        .select(F.col("doc_id").alias("id"), F.col("before.doc_id").alias("prev_id"), F.col("before.half").alias("prev_half"))
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_chars, the vectors of its text, of its edited text and of the next document, and
    edited. The next document has the next smaller doc_id (null is the smallest; after the last comes the first).

    A null text is empty. Rows that repeat a doc_id each get a row; as the next document of another, such a
    doc_id counts with its greatest text. One document alone is its own next. Other columns are ignored."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    nb = neighbours(base.groupBy("doc_id").agg(F.max(half).alias("half")))
    own = base.select("doc_id", "text", vector("text").alias("vec"))
    next_of = (
        own.join(nb, F.col("doc_id").eqNullSafe(F.col("id")))
        .select(F.col("prev_id").alias("to_id"), F.struct(F.expr("left(text, prev_half)").alias("head"), F.col("vec")).alias("next"))
        .groupBy("to_id")
        .agg(F.max("next").alias("next"))
    )
    return (
        own.join(next_of, F.col("doc_id").eqNullSafe(F.col("to_id")))
        .select("doc_id", "vec", F.char_length("text").cast("long").alias("n_chars"), F.expr("concat(left(text, char_length(text) - cast(floor(char_length(text) / 2) as int)), left(next.head, cast(floor(char_length(text) / 2) as int)))").alias("edited"), F.col("next.vec").alias("next_vec"))
        .withColumn("edited_vec", vector("edited"))
    )


def op3_fingerprints(docs: DataFrame) -> DataFrame:
    return fingerprints(docs).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("vec")).alias("fingerprint"),
        as_string(F.col("edited_vec")).alias("edited_fingerprint"),
        likeness("vec", "edited_vec").alias("near_edited"),
        likeness("vec", "next_vec").alias("near_next"),
    )
