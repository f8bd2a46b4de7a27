"""Personal data: exact base patterns, and bootstrapped contextual extraction of further identifiers.

Seeds are the base matches and secrets in assignments: values of SECRET_LENGTH characters or more behind a name and = or :,
with letters and digits and an entropy of SECRET_BITS a character or more. Every identifier-like token (a word of at
least MIN_LENGTH characters with two digits or more) and every seed is an instance; the one or two words before it, its
leading letters and the name it is assigned to are its lexical patterns. Spark scores the graph of patterns and instances
in rounds: a pattern is trusted if enough of its distinct instances are known and few are not; an instance becomes known if
a fair share of its distinct patterns is trusted, so that a number met everywhere isn't taken for a few of its contexts. What is found so, and seeds that aren't base matches, are spans of kind `id`. Rounds go on
until nothing more becomes known. Graph and tokens stay distributed.

Runs of digit groups and other words with a digit are looser instances. They are found only after patterns that are trusted
with all of them counted, and never cost a pattern its trust for identifier-like tokens. A run of MIN_LENGTH digits or more
becomes known like a token; anything shorter is common elsewhere, so it is a span only where such a pattern stands before it.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitflow.llm.common import drop_written, join_small, map_rows, quoted, text_bytes, unused, written

#: Fixed: the base kinds in the order of results; what the method finds comes after them.
KINDS = ("email", "ip", "card", "phone", "id")
DOMAIN = re.compile(r"@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")
LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile("[^0-9]+")
ANY = re.compile(rb"[0-9@]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
GROUP = r"(?:\([0-9]++\)|[0-9]++(?:[./-][0-9]++)*+)"
RUN = re.compile(rf"(?<![^\x20\x09-\x0D])[(\[{{<\"']*?({GROUP}(?: {GROUP})+)(?=[.,;:!?\"')\]}}>]*(?:[\x20\x09-\x0D]|\Z))")
DIGIT = re.compile("[0-9]")
STRIP = ".,;:!?\"'()[]{}<>"
#: Tiers of instances: identifier-like tokens and seeds, long runs of digit groups, anything shorter with a digit.
TOKEN, LONG, SHORT = 0, 1, 2
#: Values that may be secrets, and how long and how varied one must be to be a seed.
VALUE = re.compile(r"[A-Za-z0-9][A-Za-z0-9+/_-]++={0,2}")
SECRET_LENGTH, SECRET_BITS = 16, 3.0
MIN_LENGTH, MIN_DIGITS = 8, 2
#: A pattern is trusted with MIN_KNOWN known instances that are MIN_SHARE of its own; an instance becomes known with MIN_TRUSTED of its patterns.
MIN_KNOWN, MIN_SHARE, MIN_TRUSTED = 4, 0.8, 0.2


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ with a domain behind it takes the run of local characters before it, as far as the last match: what a
    search from the left finds, in linear time."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start, m = at, DOMAIN.match(text, at)
        if m:
            while start > last and not LOCAL_END.match(text, start - 1):
                start -= 1
        if m and start < at:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", *s) for s in emails(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = DIGITS.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(DIGITS.sub("", m[0])) <= 15]
    return found


def _number(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def assigned(text: str, start: int) -> str:
    """The name, in lower case, that what starts here is assigned to by = or :, quoted or not; empty if there is none."""
    at = start - 1 if start and text[start - 1] in "\"'`" else start
    while at and text[at - 1] in " \t":
        at -= 1
    if not at or text[at - 1] not in "=:":
        return ""
    while at and text[at - 1] in "=:":
        at -= 1
    while at and text[at - 1] in " \t\"'`":
        at -= 1
    end = at
    while at and (text[at - 1].isalnum() or text[at - 1] in "_-"):
        at -= 1
    return text[at:end].lower()


def is_secret(value: str) -> bool:
    if len(value) < SECRET_LENGTH or not re.search("[0-9]", value) or not re.search("[A-Za-z]", value):
        return False
    return -sum(n / len(value) * log2(n / len(value)) for n in Counter(value).values()) >= SECRET_BITS


def _patterns(before: list[str], token: str, name: str = "") -> list[int]:
    words = [w.lower() for w in before[-2:]]
    # a sign alone is no context
    out = [_number("one", words[-1])] if words and any(map(str.isalnum, words[-1])) else []
    if len(words) == 2:
        out.append(_number("two", *words))
    lead = re.match(r"[^0-9]*", token)[0]
    if len(lead) >= 4 and (lead[-1] in "=:-_/" or lead[:4].isupper()):
        out.append(_number("lead", lead[:4] if lead[:4].isupper() else lead))
    if name:
        out.append(_number("name", name))
    return out


def analyse(text: str) -> tuple[list[dict], list[dict]]:
    """The base spans, and the instances: start, end, number, seed, base, tier, patterns."""
    base = base_spans(text)
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    covered = sorted((s, e) for _, s, e in base)
    instances, k, before = [], 0, []
    seeds = {}
    for kind, s, e in base:
        seeds.setdefault(s, (e, kind))
    runs = {m.start(): m.span(1) for m in RUN.finditer(text)}
    run_end = 0

    def add(start: int, end: int, kind: str, patterns: list[int], seed: bool = False, tier: int = TOKEN) -> None:
        instances.append({"start": start, "end": end, "number": _number(kind, text[start:end]), "seed": seed, "base": kind == "base", "tier": tier, "patterns": patterns})

    for s, e in words:
        while k < len(covered) and covered[k][1] <= s:
            k += 1
        inside = k < len(covered) and covered[k][0] < e
        if inside:
            if s <= covered[k][0]:
                start = covered[k][0]
                end = seeds[start][0]
                add(start, end, "base", _patterns(before, text[s:e]), seed=True)
        elif DIGIT.search(text, s, e):
            if s in runs and not (k < len(covered) and covered[k][0] < runs[s][1]):
                start, run_end = runs[s]
                run = text[start:run_end]
                add(start, run_end, "run", _patterns(before, run), tier=LONG if len(DIGITS.sub("", run)) >= MIN_LENGTH else SHORT)
            token = text[s:e].strip(STRIP)
            start = text.index(token, s)
            secret = next(((m.start(), m.end(), name) for m in VALUE.finditer(text, s, e) if is_secret(m[0]) and (name := assigned(text, m.start()))), None)
            if secret:
                add(*secret[:2], "token", _patterns(before, token, secret[2]), seed=True)
            elif len(token) >= MIN_LENGTH and sum(map(token.count, "0123456789")) >= MIN_DIGITS:
                add(start, start + len(token), "token", _patterns(before, token, assigned(text, start)))
            elif s >= run_end:
                add(start, start + len(token), "short", _patterns(before, token, assigned(text, start)), tier=SHORT)
        before = [*before[-1:], text[s:e]]
    return [{"kind": kind, "start": s, "end": e} for kind, s, e in base], instances


SPAN = "kind string, start int, end int"
INSTANCE = "start int, end int, number long, seed boolean, base boolean, tier int, patterns array<long>"


def _analysed(docs: DataFrame) -> DataFrame:
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    instance = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("number", pa.int64()), ("seed", pa.bool_()), ("base", pa.bool_()), ("tier", pa.int32()), ("patterns", pa.list_(pa.int64()))]))

    def work(batches):
        for batch in batches:
            both = [analyse(t.decode("utf-8", "replace")) if ANY.search(t) else ([], []) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b for b, _ in both], span), pa.array([i for _, i in both], instance)], ["doc_id", "of", "base", "instances"])

    of = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    spans = [F.col("doc_id").cast("long").alias("doc_id"), of.alias("of"), text_bytes()]
    return map_rows(docs, spans, work, f"doc_id long, of long, base array<struct<{_nest(SPAN)}>>, instances array<struct<{_nest(INSTANCE)}>>")


def _nest(fields: str) -> str:
    return re.sub(r"(\w+) ", r"\1: ", fields.replace(", ", ",")).replace(",", ", ")


def bootstrap(edges: DataFrame, min_known: int = MIN_KNOWN, min_share: float = MIN_SHARE) -> tuple[DataFrame, DataFrame]:
    """edges (pattern, number, seed, base, tier), distinct, the pattern null for an instance without one, to the numbers of instances
    that are known without being base matches, and the patterns trusted with all tiers counted. What is known and trusted only
    grows, so the rounds end: when one adds nothing."""
    linked = edges.filter("pattern is not null")
    spread = written(linked.filter((~F.col("seed")) & (F.col("tier") < SHORT)).groupBy("number").agg(F.count(F.lit(1)).alias("n_patterns")), "instance-patterns")

    def trusted(known: DataFrame) -> DataFrame:
        scored = linked.join(known.withColumn("is_known", F.lit(1)), "number", "left")
        token = F.col("tier") == TOKEN
        counts = [F.count(F.when(token, 1)).alias("n_token"), F.count(F.when(token, F.col("is_known"))).alias("k_token"), F.count(F.lit(1)).alias("n"), F.count("is_known").alias("k")]
        enough = lambda n, k: (F.col(k) >= min_known) & (F.col(k) >= min_share * F.col(n))
        return scored.groupBy("pattern").agg(*counts).select("pattern", enough("n_token", "k_token").alias("for_tokens"), enough("n", "k").alias("for_all")).filter("for_tokens or for_all")

    known = written(edges.filter("seed").select("number").distinct(), "known")
    size = -1
    while size != (n := known.count()):
        size = n
        good = written(trusted(known), "trusted")
        hits = join_small(linked.filter((~F.col("seed")) & (F.col("tier") < SHORT)), good, ["pattern"], 10, ["number"]).filter((F.col("tier") == TOKEN) & F.col("for_tokens") | F.col("for_all"))
        found = hits.groupBy("number").agg(F.count(F.lit(1)).alias("n_trusted")).join(spread, "number").filter(F.col("n_trusted") >= MIN_TRUSTED * F.col("n_patterns")).select("number")
        before, known = known, written(known.union(found).distinct(), "known")
        drop_written(before)
        drop_written(good)
    return known.join(edges.filter("not base").select("number").distinct(), "number", "left_semi"), trusted(known).filter("for_all").select("pattern")


def find_pii(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, of (hash of its text), base and spans (arrays of kind, start, end in code points, end
    exclusive; by kind as in KINDS, then start).

    A null text is empty and has none. Rows that repeat a doc_id each get a row; a null doc_id stays null; an empty table
    gives an empty table; other columns are ignored."""
    table = written(_analysed(docs), "pii")
    single = table.select("doc_id", "of", F.explode("instances").alias("x")).select("doc_id", "of", "x.*")
    edges = written(single.select(F.explode_outer("patterns").alias("pattern"), "number", "seed", "base", "tier").distinct(), "pattern-graph")
    found, patterns = bootstrap(edges)
    short = join_small(single.filter(F.col("tier") == SHORT).withColumn("pattern", F.explode("patterns")), written(patterns, "trusted"), ["pattern"], 8, ["doc_id", "of", "start"])
    added = (
        join_small(single.filter("not base"), written(found, "found"), ["number"], 8, ["doc_id", "of", "start"])
        .select("doc_id", "of", "start", "end")
        .unionByName(short.select("doc_id", "of", "start", "end"))
        .distinct()
        .groupBy("doc_id", "of")
        .agg(F.array_sort(F.collect_list(F.struct(F.lit("id").alias("kind"), "start", "end"))).alias("added"))
        .withColumnsRenamed({"doc_id": "added_id", "of": "added_of"})
    )
    rows = table.select("doc_id", "of", "base").join(added, F.col("doc_id").eqNullSafe(F.col("added_id")) & (F.col("of") == F.col("added_of")), "left")
    return rows.select("doc_id", "of", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with their text's spans replaced by <KIND>; where spans overlap, the earlier, then longer one stands. Texts without
    spans stay as they are, null included. Every other column stays."""
    name, whole = unused(docs.columns, "found", "whole")
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("stop"), s["kind"].alias("kind")))
    found = find_pii(docs).filter(F.size("spans") > 0).dropDuplicates(["doc_id", "of"]).select(F.struct("doc_id", "of", F.array_sort(spans).alias("spans")).alias(name))
    own = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{name}.doc_id")) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col(f"{name}.of"))
    full = docs.withColumn(whole, F.col("text")).join(found, own, "left")
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, s: F.when(s["start"] < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], -s["stop"]).alias("at"))).otherwise(
        F.struct(F.concat(a["out"], F.substring(F.col(whole), a["at"] + 1, s["start"] - a["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out"), (-s["stop"]).alias("at"))
    )
    done = F.aggregate(F.col(f"{name}.spans"), zero, step, lambda a: F.concat(a["out"], F.substring(F.col(whole), a["at"] + 1, F.lit(2147483647))))
    return full.withColumn("text", F.when(F.col(name).isNull(), F.col(whole)).otherwise(done)).select(*quoted(docs.columns))


def as_text(spans: str):
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_pii(docs: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_pii(docs.select("doc_id", "text")).select("doc_id", *map(count, KINDS[:4]), F.sha2(as_text("base"), 256).alias("base_sha256"), as_text("spans").alias("spans"))
