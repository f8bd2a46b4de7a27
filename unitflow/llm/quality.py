"""Quality rules (native): a ledger of every rule's outcome, policies over it, and ablations.

Each rule is evaluated once per document. The ledger keeps the measurements and one failure bit per rule;
policies are versioned bit masks over it, so that a new policy or an ablation never reads a text again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitflow.llm.common import SPACE_CLASS, quoted, unused

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars_all", "n_upper", "n_exclaim"]

#: Rule by bit. Ratios are kept as integer inequalities.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbol_heavy", "100 * n_symbols > 30 * n_words"),
    ("duplicate_lines", "n_dup_lines >= 3 and 100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    ("shouting", "n_upper > 50 and 100 * n_upper > 50 * word_chars"),
    ("exclamations", "n_exclaim > 10 and 100 * n_exclaim > 50 * n_words"),
]
BIT = {name: i for i, (name, _) in enumerate(RULES)}

#: Policy versions: the rules whose failure rejects a document.
POLICIES: dict[str, list[str]] = {
    "base": ["too_few_words", "repeated_windows"],
    "v1": [name for name, _ in RULES],
}


def mask(rules: list[str]) -> int:
    return sum(1 << BIT[name] for name in rules)


def _pairs(hashes: Column, distance: int) -> Column:
    """Element i: a hash of elements i and i + distance; as many as there are such pairs."""
    n = F.size(hashes) - distance
    return F.when(n > 0, F.zip_with(F.slice(hashes, 1, F.greatest(n, F.lit(0))), F.slice(hashes, distance + 1, F.greatest(n, F.lit(0))), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<long>"))


def _covered(windows: Column, width: int) -> Column:
    """Positions that lie in a window whose hash occurs twice or more. Hashes are sorted with their positions; a
    window repeats if a neighbour has its hash; the starts, sorted again, each cover up to the next start."""
    by_hash = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(x: Column, k: Column, of: Column) -> Column:
        return (x["h"] == F.get(of, k - 1)["h"]) | (x["h"] == F.get(of, k + 1)["h"])

    def starts(of: Column) -> Column:
        return F.array_sort(F.transform(F.filter(of, lambda x, k: F.coalesce(repeated(x, k, of), F.lit(False))), lambda x: x["i"]))

    gaps = lambda at: F.transform(at, lambda s, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - s, F.lit(width))))
    # aggregate() over one element binds a value once, where a plain expression would be evaluated at each use
    bind = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    return bind(by_hash, lambda of: bind(starts(of), lambda at: F.aggregate(gaps(at), F.lit(0), lambda a, g: a + g)))


def measure(docs: DataFrame) -> DataFrame:
    """docs with the measurements. Words are maximal runs of non-white-space (ASCII); a null text has none.

    n_repeat_words counts the words in eight-word windows found twice or more in the text, first included;
    n_dup_lines the lines with a word that equal an earlier line."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keep = quoted([c for c in docs.columns if c.lower() not in MEASURES])
    full, words, lines, w, twice = unused([*docs.columns, *MEASURES], "full", "words", "lines", "w", "twice")
    step = docs.select(*keep, text.alias(full))
    step = step.select("*", F.filter(F.split(full, SPACE_CLASS + "+", -1), lambda x: x != "").alias(words))
    step = step.select("*", F.filter(F.split(full, "\n", -1), lambda line: F.btrim(line, F.lit(" \t\n\x0b\f\r")) != "").alias(lines))
    step = step.withColumn(w, F.transform(words, lambda x: F.xxhash64(x)))
    for distance in (1, 2, 4):
        step = step.withColumn(w, _pairs(F.col(w), distance))
    step = step.withColumn(twice, F.size(F.array_distinct(w)) < F.size(w))
    count = lambda cls: F.length(F.regexp_replace(full, f"[^{cls}]+", "")).cast("long")
    return step.select(
        *keep,
        F.size(words).cast("long").alias("n_words"),
        F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
        count("#*$%&|<>").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(F.col(twice), _covered(F.col(w), 8)).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.length(full).cast("long").alias("n_chars_all"),
        count("A-Z").alias("n_upper"),
        count("!").alias("n_exclaim"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """docs, the measurements, and failed: a long whose bit k is set if rule k of RULES fails.

    Null and empty texts have no words and fail too_few_words alone. Rows are independent: repeated rows give
    repeated results, an empty table an empty ledger; columns named like a measurement are replaced."""
    bits = [F.when(F.expr(test), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, test) in enumerate(RULES)]
    return measure(docs.drop("failed")).withColumn("failed", reduce(lambda a, b: a.bitwiseOR(b), bits))


def judge(led: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with kept under a policy: no rule of the policy failed."""
    return led.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0)


def ablations(led: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and that the policy would keep without
    it. The ledger is first reduced to counts by failure mask, of which there are at most 2 to the rules."""
    spark = led.sparkSession
    masks = led.groupBy(F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))).alias("failed")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.broadcast(spark.createDataFrame([(name, 1 << BIT[name]) for name in POLICIES[policy]], "rule string, bit long"))
    hit = F.col("failed").bitwiseAND(F.col("bit")) != 0
    return (
        masks.join(rules)
        .groupBy("rule")
        .agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("failed") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"), F.sum(F.when(F.col("failed").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"))
    )


def op8_quality(docs: DataFrame) -> DataFrame:
    led = judge(ledger(docs.select("doc_id", "text")))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("failed").bitwiseAND(F.lit(mask(POLICIES["base"]))) != 0).alias("base_failed"), "kept", "failed")
