"""Repair of conversations: each row's first fault, and the cheapest edits that leave roles of the form (s?(ua)+)?.

A run of at most 4,096 rows of a conversation is written as a signature, one letter a row: what stands in the way of keeping it, not
its text. Equal signatures are solved once, for every state that a run may begin and end in, by memoised recursion; the costs of a
conversation's runs are put together, the chosen edits are joined back, and replayed on the rows. So a conversation of any length is
dealt over many tasks: only a few numbers a run meet in one.
"""

from __future__ import annotations

import hashlib
import sys
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitflow.llm.common import ASCII_SPACE, map_rows, written

#: Rows of a signature, as a power of two.
RUN_BITS = 12
#: What edits cost, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after the system row, after a user row, after an assistant row. From each what comes next and the state then.
STATES = 4
KEEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "x": {}}
#: Inserts that end a conversation in each state: a user row is I, an assistant row i (r and R likewise for other roles of a row).
TAILS = {0: "", 1: "Ii", 2: "i", 3: ""}


def solve(signature: str) -> list[tuple[int, str] | None]:
    """For every state before (q) and after (p) the run, at place 4 q + p: the least cost and its edits, None where there are none.

    Letters are s, u, a, x (other roles); upper case where the row is truncated; - where it must go. Edits are D, K, R or r, each with
    the inserts before it; those behind the last row belong to the next run. Of equal costs the ASCII-least in upper case is taken: from
    one state, edits of one letter lead to one state, so the first letter that differs decides."""
    memo: dict[tuple[int, int, int], list] = {}
    n = len(signature)

    def moves(i: int, q: int, inserted: int):
        code = signature[i]
        yield DELETE, "D", (i + 1, q, 0)
        to = 3 if q == 2 else 2
        if inserted < 2:  # a third would come back to a state that was there before
            yield INSERT, "i" if q == 2 else "I", (i, to, inserted + 1)
        if code != "-":
            more = TRUNCATED if code.isupper() else 0
            kept = KEEPS[code.lower()].get(q)
            if kept is not None:
                yield more, "K", (i + 1, kept, 0)
            yield REROLE + more, "r" if q == 2 else "R", (i + 1, to, 0)

    def best(at: tuple[int, int, int]) -> list:
        found = memo.get(at)
        if found is None:
            i, q, inserted = at
            if i == n:
                found = [(0, "", None) if p == q and not inserted else None for p in range(STATES)]
            else:
                found = [None] * STATES
                for cost, edit, to in moves(*at):
                    for p, rest in enumerate(best(to)):
                        if rest and (found[p] is None or (cost + rest[0], edit.upper()) < (found[p][0], found[p][1].upper())):
                            found[p] = cost + rest[0], edit, to
            memo[at] = found
        return found

    deep = sys.getrecursionlimit()
    sys.setrecursionlimit(max(deep, 4 * n + 1000))
    out: list[tuple[int, str] | None] = []
    for q in range(STATES):
        for p in range(STATES):
            at, edits = (0, q, 0), []
            while best(at)[p] and best(at)[p][2]:
                edits.append(best(at)[p][1])
                at = best(at)[p][2]
            first = best((0, q, 0))[p]
            out.append((first[0], "".join(edits)) if first else None)
    sys.setrecursionlimit(deep)
    return out


_SOLVED = "signature string, costs array<int>, ranks array<int>, edits array<string>"


def _solved(signatures: DataFrame) -> DataFrame:
    """Distinct signatures with what solve() says of each; ranks order the edits of one state before by their audits."""

    def work(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                names = batch.column(0).slice(k, 64).to_pylist()
                rows = []
                for name in names:
                    found = solve(name)
                    order = sorted((f[1].upper(), place) for place, f in enumerate(found) if f)
                    rank = {place: r for r, (_, place) in enumerate(order)}
                    rows.append((name, [f and f[0] for f in found], [rank.get(place) for place in range(len(found))], [f and f[1] for f in found]))
                types = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["signature", "costs", "ranks", "edits"])

    return map_rows(signatures, ["signature"], work, _SOLVED)


def chosen(costs: list[list[int | None]], ranks: list[list[int | None]]) -> tuple[int, list[int], str]:
    """Of a conversation's runs in order: the least cost, the place 4 q + p chosen in each, the inserts at the end."""
    after = [INSERT * len(TAILS[p]) for p in range(STATES)]
    picks = []
    for cost, rank in zip(reversed(costs), reversed(ranks)):
        best = []
        for q in range(STATES):
            ways = [(cost[4 * q + p] + after[p], rank[4 * q + p], p) for p in range(STATES) if cost[4 * q + p] is not None]
            best.append(min(ways))
        picks.append([4 * q + best[q][2] for q in range(STATES)])
        after = [b[0] for b in best]
    state, out = 0, []
    for pick in reversed(picks):
        out.append(pick[state])
        state = pick[state] % STATES
    return after[0], out, TAILS[state]


def _composed(runs: DataFrame) -> DataFrame:
    """Per conversation: cost, illegal pairs, tail, and per run its block and the chosen place."""
    lists = runs.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "costs", "ranks", "illegal", "first", "last"))).alias("runs"))

    def work(batches):
        for batch in batches:
            rows = []
            for conv, runs in zip(batch.column(0).to_pylist(), batch.column(1)):
                runs = runs.as_py()
                cost, picks, tail = chosen([r["costs"] for r in runs], [r["ranks"] for r in runs])
                illegal = sum(r["illegal"] for r in runs) + sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(runs, runs[1:]))
                rows.append((conv, cost, illegal, tail, [r["block"] for r in runs], picks))
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], ["conv", "cost", "illegal", "tail", "blocks", "picks"])

    return map_rows(lists, ["conv", "runs"], work, "conv string, cost long, illegal long, tail string, blocks array<bigint>, picks array<int>")


def _key(name: str) -> Column:
    """A column as text, null as one space."""
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def _back(rows: DataFrame, kind) -> DataFrame:
    return rows.withColumn("conv_id", F.when(F.col("conv") != " ", F.col("conv")).cast(kind)).drop("conv")


@dataclass
class Repaired:
    """audits: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. rows: conv_id, at, nth (their order), edit, role, text."""

    audits: DataFrame
    rows: DataFrame


def repair(conversations: DataFrame) -> Repaired:
    """conversations (conv_id, turn, role, text) with their faults and cheapest repairs.

    Rows of a conversation are in order of turn (nulls first), ties by role and a hash of the text. A row is blank without any but
    ASCII white space, else duplicate if role and text were seen earlier, else truncated if its last other character isn't one of
    .!?. Null roles and texts count as one space, a null conv_id as a conversation of its own; repeated rows are duplicates. Roles
    stand by their first character. Gaps is the span of turns less their distinct number (0 where all are null). A conversation
    without rows isn't there; an empty table gives empty ones; other columns are ignored. Texts are compared by two 64-bit hashes."""
    kind = conversations.schema["conv_id"].dataType
    text = _key("text")
    bare = F.rtrim(text, F.lit(ASCII_SPACE))
    initial = F.substring(_key("role"), 1, 1)
    state = F.when(bare == "", "blank").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    told = conversations.select(_key("conv_id").alias("conv"), "turn", _key("role").alias("role"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit("again"), text).alias("g"), F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("class"), state.alias("state"), text.alias("text"))
    order = ["conv", "turn", "role", "h"]
    # conversations lie in order over range partitions; the row's number in its partition shows where a run ends
    rows = written(told.drop("text").repartitionByRange(*order).sortWithinPartitions(*order, "g").withColumn("at", F.monotonically_increasing_id()), "conversation-rows")
    first = rows.groupBy("conv", "role", "h", "g").agg(F.min("at").alias("at"))
    seen = rows.join(first.select("at", F.lit(True).alias("new")), "at", "left")
    fault = F.when(F.col("state") == "blank", "blank").when(F.col("new").isNull(), "duplicate").otherwise(F.col("state"))
    code = F.when(fault.isin("blank", "duplicate"), "-").when(fault == "truncated", F.upper("class")).otherwise(F.col("class"))
    each = seen.select("conv", "at", F.shiftright("at", RUN_BITS).alias("block"), "turn", "class", fault.alias("fault"), code.alias("code"))
    held = F.array_sort(F.collect_list(F.struct("at", "code", "class")))
    runs = each.groupBy("conv", "block").agg(held.alias("held"), *[F.sum((F.col("fault") == f).cast("long")).alias(f) for f in ("blank", "duplicate", "truncated")], F.min("turn").alias("low"), F.max("turn").alias("high"))
    joined = lambda part: F.array_join(F.transform("held", lambda x: x[part]), "")
    runs = runs.withColumn("classes", joined("class")).withColumn("signature", joined("code")).withColumn("start", F.col("held")[0]["at"])
    pairs = F.transform(F.sequence(F.lit(1), F.length("classes") - 1), lambda k: F.substr("classes", k, F.lit(2)))
    illegal = F.when(F.length("classes") > 1, F.size(F.filter(pairs, lambda x: ~x.isin("su", "ua", "au")))).otherwise(0)
    runs = written(runs.select("conv", "block", "start", "signature", "blank", "duplicate", "truncated", "low", "high", illegal.alias("illegal"), F.substring("classes", 1, 1).alias("first"), F.substring("classes", -1, 1).alias("last")), "conversation-runs")

    # many runs share a signature: each bucket of runs fetches a solution once, so no signature is a hot key
    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.withColumn("bucket", F.pmod(F.xxhash64("conv", "block"), F.lit(n)))
    asked = dealt.select("signature", "bucket").distinct()
    answers = asked.join(_solved(runs.select("signature").distinct()), "signature")
    solved = written(dealt.join(answers, ["signature", "bucket"]).drop("bucket", "signature"), "conversation-solved")
    composed = written(_composed(solved), "conversation-edits")

    picked = composed.select("conv", F.posexplode(F.arrays_zip("blocks", "picks")).alias("k", "run"), F.size("blocks").alias("n"), "tail")
    picked = picked.select("conv", F.col("run.blocks").alias("block"), F.col("run.picks").alias("pick"), F.when(F.col("k") == F.col("n") - 1, F.col("tail")).otherwise("").alias("tail"))
    edits = solved.join(picked, ["conv", "block"]).select("conv", "block", "start", F.element_at("edits", F.col("pick") + 1).alias("edits"), "tail")
    spelled = F.transform(F.array_sort(F.collect_list(F.struct("block", F.upper(F.concat("edits", "tail")).alias("letters")))), lambda x: x["letters"])
    audits = edits.groupBy("conv").agg(F.array_join(spelled, "").alias("audit"))
    turns = rows.groupBy("conv").agg(F.countDistinct("turn").alias("turns"))
    counts = runs.groupBy("conv").agg(*[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")], F.min("low").alias("low"), F.max("high").alias("high")).join(turns, "conv")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps")
    audits = counts.join(composed, "conv").join(audits, "conv").select("conv", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    steps = edits.select("conv", "start", F.posexplode(F.regexp_extract_all("edits", F.lit("[Ii]*[DKRr]"), F.lit(0))).alias("k", "step")).filter("step <> 'D'")
    # a row that stays is the first of its role and text, so these name it
    texts = told.groupBy("conv", "role", "h", "g").agg(F.first("text").alias("text"))
    stay = steps.select((F.col("start") + F.col("k")).alias("at"), "step").join(first, "at").join(texts, ["conv", "role", "h", "g"])
    ends = edits.filter("tail <> ''").select("conv", F.lit((1 << 63) - 1).alias("at"), F.col("tail").alias("step"), F.lit("").alias("role"), F.lit("").alias("text"))
    made = stay.select("conv", "at", "step", "role", "text").unionByName(ends).select("conv", "at", F.posexplode(F.regexp_extract_all("step", F.lit("."), F.lit(0))).alias("nth", "edit"), "role", "text")
    role = F.when(F.col("edit").isin("I", "R"), "user").when(F.col("edit").isin("i", "r"), "assistant").otherwise(F.col("role"))
    made = made.select("conv", "at", "nth", F.upper("edit").alias("edit"), role.alias("role"), F.when(F.lower("edit") == "i", "").otherwise(F.col("text")).alias("text"))
    return Repaired(_back(audits, kind), _back(made, kind))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the damage that the query is stated over, by crc32 of conv_id:turn modulo 20."""
    kind = F.crc32(F.concat(_key("conv_id"), F.lit(":"), _key("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", _key("role").alias("role"), _key("text").alias("text"), kind.alias("damage")).filter("damage <> 0")
    rows = rows.withColumn("text", F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.when(F.col("damage") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def digests(rows: DataFrame) -> DataFrame:
    """Per conversation the SHA-256 of its rows, as role:text in order, joined by line ends. A digest is made byte after byte, so one task
    reads a conversation; it holds one row at a time."""
    sorted_rows = rows.withColumn("conv", _key("conv_id")).repartition("conv").sortWithinPartitions("conv", "at", "nth")

    def work(batches):
        conv, digest = None, None
        names = ["conv", "repaired_sha256"]
        for batch in batches:
            done = []
            for of, role, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                of, line = of.as_py(), f"{role.as_py()}:{text.as_py()}".encode()
                if of != conv:
                    if digest is not None:
                        done.append((conv, digest.hexdigest()))
                    conv, digest = of, hashlib.sha256(line)
                else:
                    digest.update(b"\n" + line)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], names)
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([digest.hexdigest()])], names)

    return map_rows(sorted_rows, ["conv", "role", "text"], work, "conv string, repaired_sha256 string")


def op12_conversations(conversations: DataFrame) -> DataFrame:
    kind = conversations.schema["conv_id"].dataType
    found = repair(damaged(conversations))
    every = conversations.select(_key("conv_id").alias("conv")).distinct()
    audits = found.audits.withColumn("conv", _key("conv_id")).drop("conv_id")
    whole = every.join(audits, "conv", "left").join(digests(found.rows), "conv", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return _back(whole, kind).select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
