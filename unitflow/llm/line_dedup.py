"""Line dedup (native): drops lines that many documents hold, all but those of one document.

Lines are normalised, hashed and exploded; documents are counted per hash; lines over the threshold go; the
rest are put together again by position. Texts never leave their row to be counted: what is shuffled for the
count is (document, position, two 64-bit hashes) of lines that are long enough, pre-aggregated per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitflow.llm.common import ASCII_SPACE, drop_written, join_small, quoted, unused, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z only. lower() does that, and faster, where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _kept(lines: Column, drop: Column) -> Column:
    """The lines whose positions aren't in drop (sorted, from 0), as the runs between dropped ones."""
    n = F.size(drop)
    start = lambda i: F.when(i == 0, 0).otherwise(F.get(drop, i - 1) + 1)
    end = lambda i: F.when(i == n, F.size(lines)).otherwise(F.get(drop, i))
    runs = F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(lines, start(i) + 1, end(i) - start(i)))
    return F.array_join(F.flatten(runs), "\n")


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text; other columns stay, but ones of these names are replaced.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of at least min_chars code
    points in at least min_docs documents lose all their lines, except in the largest doc_id that holds them.
    Null or empty text: one empty line. Rows that repeat a doc_id count as one document for a key, and each
    keeps or loses the line alike. A null doc_id is one document below every other. An empty table gives an
    empty table.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(i.alias("pos"), F.btrim(line, F.lit(ASCII_SPACE)).alias("line")))
    long_ones = F.filter(trimmed, lambda x: F.char_length(x["line"]) >= min_chars)
    # of two rows with one doc_id, a position belongs to one text
    lines = docs.select("doc_id", F.xxhash64(text).alias("of"), F.explode(long_ones).alias("x"))
    lines = lines.select("doc_id", "of", "x.pos", ascii_lower(F.col("x.line")).alias("key"))
    lines = lines.select("doc_id", "of", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"))

    # keys of enough lines hold those of enough documents; only for these are documents counted exactly
    often = written(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs).drop("n"), "line-keys")
    hits = written(join_small(lines, often, ["h1", "h2"], 16, ["doc_id", "of", "pos"]).groupBy("h1", "h2", "doc_id", "of").agg(F.collect_list("pos").alias("pos")), "line-hits")
    drop_written(often)
    per_doc = hits.select("h1", "h2", "doc_id").distinct()
    frequent = per_doc.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep")).filter(F.col("n") >= min_docs).drop("n")
    dropped = (
        join_small(hits, written(frequent, "line-frequent"), ["h1", "h2"], 24, ["doc_id", "of"])
        .filter(~F.col("doc_id").eqNullSafe(F.col("keep")))
        .groupBy("doc_id", "of")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pos")))).alias("at"))
    )
    name = unused(docs.columns, "dropped")[0]
    lines, drop = F.split(text, "\n", -1), F.col(f"{name}.at")
    found = drop.isNotNull()
    return (
        docs.join(dropped.select(F.struct("doc_id", "of", "at").alias(name)), F.col("doc_id").eqNullSafe(F.col(f"{name}.doc_id")) & (F.xxhash64(text) == F.col(f"{name}.of")), "left")
        .select(
            *quoted(docs.columns),
            F.size(lines).cast("long").alias("n_lines"),
            F.when(found, F.size(drop)).otherwise(0).cast("long").alias("n_dropped"),
            F.when(found, _kept(lines, drop)).otherwise(text).alias("kept_text"),
        )
    )


def op1_line_dedup(docs: DataFrame) -> DataFrame:
    return line_dedup(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = """
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from documents),
keyed as (
  select doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines),
frequent as (
  select key, max(doc_id) as keep from keyed where length(key) >= 40
  group by key having count(distinct doc_id) >= 5),
marked as (
  select k.doc_id, k.pos, k.line, f.key is not null and k.doc_id <> f.keep as gone
  from keyed k left join frequent f on k.key = f.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""
