"""Reviews of units in callees-first order: summaries level by level, then all passes at once.

Units of one level don't depend on each other, so a level is one distributed stage; its summaries are written before
the next one reads them. Issue passes need nothing but summaries and form one stage of units x passes. Requests are dealt into small
tasks, and each task's answers are committed when it ends, under a name of its own: a stage that fails keeps what was answered, and a
restart asks the rest. Known summaries come from the cache table by content hash.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unitflow.functions import models
from unitflow.functions import text as T
from unitflow.functions.tables import drop_written, shared_dir, written
from unitflow.operators import graph, lookups
from unitflow.plans import prompts
from unitflow.plans.extract import Extracted
from unitflow.plans.report import POSITION

TOLD = "struct<purpose: string, behavior: string, invariants: array<string>, security: array<string>>"
#: The cache is a table in so many parts by a hash of its keys; what isn't asked for is neither read nor rewritten.
CACHE, CACHE_PARTS = "cache_key string, payload string, part int", 256
#: A stage has at most so many tasks: each is a part of a shuffle and a file of answers, of which the driver holds the list.
TASKS = 1000
ANSWERS = "id string, pass string, payload string"
FOUND = "struct<issues: array<struct<function: string, line: long, code: string, severity: string, message: string, suggestion: string>>>"


@dataclass
class Pass:
    """prompt: builtin:NAME or a file; None for the builtin prompt of its name."""

    name: str
    prompt: str | None = None
    enabled: bool = True
    llm: dict | None = None
    inline_prompt: str = ""
    prompt_dir: str = ""

    def __post_init__(self):
        if self.prompt is None:
            self.prompt = "" if self.inline_prompt else f"builtin:{self.name}"


@dataclass
class Config:
    """state: a folder that all share, where finished levels and answers stay, so that a review that stopped goes on from there;
    empty for none. prompts: a folder that builtin prompts are read from instead. language: in place of the index's. progress: called
    on the driver with a phase and its number of requests, before they are sent. tally: called there with a phase and its issues so
    far by severity whenever tasks have ended, the last time with all of them; answers that were there before don't count. step:
    about so many requests are a task, whose answers are kept together; more where a stage would have over TASKS tasks."""

    llm: dict = field(default_factory=lambda: {"model": "", "max_tokens": 32768, "temperature": 0.1})
    passes: list[Pass] = field(default_factory=lambda: [Pass(name) for name in ("summary", "baseline")])
    cache: str = ""
    state: str = ""
    prompts: str = ""
    language: str = ""
    progress: Callable[[str, int], None] | None = None
    tally: Callable[[str, dict[str, int]], None] | None = None
    step: int = 50


class _Counts(AccumulatorParam):
    """Counters that tasks add to; Spark adds those of a task once, when it has succeeded."""

    def zero(self, value):
        return Counter()

    def addInPlace(self, a, b):  # noqa: N802
        return a + b


def _ask(rows: DataFrame, client: models.Client, settings: dict, kind: str, counts=None) -> DataFrame:
    """rows (id, pass, context as JSON) to (id, pass, payload): decoded answers as JSON. settings by pass: template, llm. counts: an
    accumulator of issues by severity."""

    def work(batches):
        for batch in batches:
            ids, names, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, name, ctx in zip(ids, names, batch.column(2).to_pylist()):
                own = settings[name]
                text = prompts.prompt(own["template"], json.loads(ctx), name == "type_summary")
                request = own["llm"] | {"id": i, "pass": name, "prompt": text, "schema": models.SUMMARY if kind == "summary" else models.ISSUES}
                answer = models.decoded(client.complete(request), kind)
                if counts is not None:
                    counts.add(Counter(i["severity"] for i in answer.get("issues", ())))
                out.append(json.dumps(answer, ensure_ascii=False, separators=(",", ":")))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(names, pa.string()), pa.array(out, pa.string())], ["id", "pass", "payload"])

    return rows.select("id", "pass", "context").mapInArrow(work, ANSWERS)


def cache_part(key: str) -> Column:
    return (F.crc32(F.col(key).cast("binary")) % CACHE_PARTS).cast("int")


def remember(rows: DataFrame, cache: str) -> None:
    """Adds rows (cache_key, payload) to the cache."""
    rows.select("cache_key", "payload", cache_part("cache_key").alias("part")).repartition("part").write.mode("append").partitionBy("part").parquet(cache)


def _in_parts(spark: SparkSession, cache: str) -> None:
    """Moves rows that lie in the cache's folder itself into parts."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    flat = [f.getPath() for f in fs.listStatus(folder) if f.isFile() and f.getPath().getName().endswith(".parquet")]
    if flat:
        remember(spark.read.schema("cache_key string, payload string").parquet(*[f.toString() for f in flat]), cache)
        for f in flat:
            fs.delete(f, False)


def read_cache(spark: SparkSession, cache: str, keys: DataFrame | None = None) -> DataFrame:
    """The cache's rows (cache_key, payload), of the parts only that keys (cache_key) are in where these are given; a cache that isn't
    there yet is empty."""
    spark.createDataFrame([], CACHE).write.mode("append").partitionBy("part").parquet(cache)
    _in_parts(spark, cache)
    held = spark.read.schema(CACHE).parquet(cache)
    if keys is not None:
        held = held.filter(F.col("part").isin(_parts(keys)))
    return held.select("cache_key", "payload")


def _parts(keys: DataFrame) -> list[int]:
    """The cache's parts that the keys are in, at most CACHE_PARTS."""
    return sorted(r[0] for r in keys.select(cache_part("cache_key")).distinct().collect() if r[0] is not None)


def forget(spark: SparkSession, cache: str, keys: DataFrame) -> None:
    """Deletes the entries of these keys (cache_key); keys that it doesn't hold change nothing. Other parts stay as they are."""
    keys = keys.select("cache_key").distinct()
    rest = written(read_cache(spark, cache, keys).join(keys, "cache_key", "left_anti").withColumn("part", cache_part("cache_key")))
    rest.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(cache)
    left = {r[0] for r in rest.select("part").distinct().collect()}
    for part in set(_parts(keys)) - left:  # overwriting leaves parts alone that get no rows
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{cache.rstrip('/')}/part={part}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    drop_written(rest)


class State:
    """Answers (id, pass, payload) by step, each step a table in the folder. What a table holds is read, not asked again."""

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config
        self.folder = config.state.rstrip("/") or f"{shared_dir(spark)}/review-{uuid.uuid4().hex}"

    def tasks(self, n: int) -> int:
        return max(1, min(TASKS, -(-n // self.config.step)))

    def keep(self, name: str, rows: DataFrame, ask: Callable, cache: str = "") -> DataFrame:
        """rows come dealt into tasks(), as long as all are asked; without a cache they aren't written. The answers to rows (id, pass, context; cache_key with a cache); ask(rows, counts) makes those that neither the step's table
        nor the cache has. Tasks commit their answers one by one into the table (the output committer's second algorithm, under a name
        of the job and the task), so that those of ended tasks are there whatever happens to the others."""
        path, key = f"{self.folder}/{name}", ["id", "pass"]
        if cache:
            rows = written(rows)
        if self.config.progress:
            self.config.progress(name, rows.count())
        self.spark.createDataFrame([], ANSWERS).write.mode("append").parquet(path)
        done = lambda: self.spark.read.schema(ANSWERS).parquet(path).groupBy(*key).agg(F.max("payload").alias("payload"))
        fresh = not cache and done().isEmpty()
        rest = rows if fresh else rows.join(done().select(*key), key, "left_anti")
        if cache:
            held = read_cache(self.spark, cache, rest).filter(F.from_json("payload", TOLD, {"mode": "PERMISSIVE"})["purpose"].isNotNull())
            found = lookups.cached(rest, held, "cache_key", "payload").filter("payload is not null")
            found.select(*key, "payload").write.mode("append").parquet(path)
            rest = rows.join(done().select(*key), key, "left_anti")
        n = None if fresh and not self.config.tally else rest.select(*key).count()
        if n != 0:
            counts = self.spark.sparkContext.accumulator(Counter(), _Counts())
            asked = ask(rest if fresh else rest.repartition(self.tasks(n), *key), counts)
            with _Telling(self.config.tally, name, counts):
                asked.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
        if cache:
            new = rows.select(*key, "cache_key").join(done(), key).select("cache_key", "payload")
            remember(new.join(read_cache(self.spark, cache, new).select("cache_key").distinct(), "cache_key", "left_anti").groupBy("cache_key").agg(F.max("payload").alias("payload")), cache)
        return done() if fresh else done().join(rows.select(*key), key, "left_semi")


def summaries(spark: SparkSession, state: str) -> DataFrame:
    """What a review with this state folder has been told so far: kind (unit or type), id, purpose, behavior, invariants, security."""
    held = spark.read.schema(ANSWERS).parquet(f"{state.rstrip('/')}/types", f"{state.rstrip('/')}/level-*")
    held = held.groupBy("id", "pass").agg(F.max("payload").alias("payload")).withColumn("told", F.from_json("payload", TOLD))
    return held.select(F.when(F.col("pass") == "type_summary", "type").otherwise("unit").alias("kind"), "id", "told.*")


class _Telling:
    """While it is open, tells the counts whenever they have changed, and once more at the end."""

    def __init__(self, tell: Callable[[str, dict], None] | None, phase: str, counts, every: float = 0.5):
        self.tell, self.phase, self.counts, self.every, self.over, self.last = tell, phase, counts, every, threading.Event(), None

    def _watch(self) -> None:
        while not self.over.wait(self.every):
            self._say()

    def _say(self) -> None:
        now = dict(self.counts.value)
        if now != self.last:
            self.last = now
            self.tell(self.phase, now)

    def __enter__(self):
        if self.tell:
            self.thread = threading.Thread(target=self._watch, daemon=True)
            self.thread.start()

    def __exit__(self, *_):
        if self.tell:
            self.over.set()
            self.thread.join()
            self._say()


def review(spark: SparkSession, ex: Extracted, client: models.Client, config: Config, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Tables for the report: units and issues of all units but those in done (units of an earlier report), whose summaries
    are used as they are. With config.state, levels and answers that were finished before are read instead of asked again; the
    folder belongs to one review of one index."""
    first = None if config.language else ex.language.first()
    language = F.lit(config.language or (first[0] if first else "source")).alias("language")
    templates = prompts.load_all(config.passes, config.prompts)
    settings = {p.name: {"template": templates[p.name], "llm": p.llm or config.llm} for p in config.passes if p.enabled}
    if "summary" not in settings:
        raise ValueError("summary prompt not loaded")
    settings["type_summary"] = {"template": templates["type_summary"], "llm": settings["summary"]["llm"]}
    state = State(spark, config)
    summaries = lambda rows, counts: _ask(rows, client, settings, "summary")
    none = F.array()

    # types
    fns = ex.functions
    shown = fns.select("fn_id", F.struct("name", "signature", "doc").alias("m"))
    listed = ex.types.select("type_id", F.posexplode("methods").alias("at", "fn_id")).join(shown, "fn_id")
    listed = written(listed.select("type_id", "at", "fn_id", "m"))
    methods = lookups.listed(listed, "type_id", ["at"], "m", "methods")
    types = ex.types.drop("methods").repartition(state.tasks(ex.types.count()), "type_id").join(methods, "type_id", "left")
    signatures = F.array_join(F.transform(F.coalesce("methods", none.cast("array<struct<name: string, signature: string, doc: string>>")), lambda m: m["signature"]), "")
    asked = types.select(F.col("type_id").alias("id"), F.lit("type_summary").alias("pass"), F.to_json(F.struct(language, "kind", "name", "package", "signature", "body", "doc", "methods")).alias("context"), T.content_hash(F.col("body"), F.col("doc"), signatures).alias("cache_key"))
    type_told = state.keep("types", asked, summaries, config.cache).drop("pass").withColumnsRenamed({"id": "type_id", "payload": "type_payload"})

    # what of a unit's context doesn't depend on callees
    places = written(ex.members.select("fn_id", "scc").join(ex.units.select("scc", "unit_id"), "scc").join(fns.select("fn_id", "receiver_type"), "fn_id").drop("scc"))
    owners = places.groupBy("unit_id").agg(F.min("receiver_type").alias("lo"), F.max("receiver_type").alias("hi"))
    owner = written(owners.select("unit_id", F.when(F.col("lo") == F.col("hi"), F.nullif("lo", F.lit(""))).alias("type_id")).filter("type_id is not null"))
    own = places.select("unit_id", "fn_id").join(owner, "unit_id")
    # bodies move to their unit, and not before it and all that is told about it are known
    told_of = places.join(type_told, F.col("receiver_type") == F.col("type_id"), "left").select("unit_id", "fn_id", F.coalesce("type_payload", F.lit("")).alias("told"))
    grouped = fns.join(told_of, "fn_id").groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("fn_id", "name", "package", "receiver", "signature", "body", "doc", "position", "told"))).alias("functions"))
    siblings = lookups.listed(lookups.siblings(listed, "type_id", "fn_id", own, "unit_id"), "unit_id", ["at"], "m", "methods")
    receiver = owner.join(ex.types.drop("methods"), "type_id").join(type_told, "type_id", "left").join(siblings, "unit_id", "left").select("unit_id", F.struct("name", "kind", "signature", "body", "doc", F.from_json("type_payload", TOLD).alias("summary"), "methods").alias("receiver"))
    outside = ex.units.select("unit_id", F.posexplode("externals").alias("at", "ext_id")).join(ex.externals, "ext_id").withColumn("e", F.struct("package", "name", "signature", "doc"))
    outside = lookups.listed(outside, "unit_id", ["at"], "e", "outside")
    base = written(grouped.join(receiver, "unit_id", "left").join(outside, "unit_id", "left").join(graph.unit_levels(ex.units.select("unit_id"), ex.calls.select("unit_id", "callee")), "unit_id"))
    calls = ex.calls.select("unit_id", F.col("ord").alias("at"), "callee")

    told = None
    if done is not None:
        told = done.select("unit_id", F.to_json(F.struct(*[F.coalesce(F.col(c), none.cast("array<string>") if c in ("invariants", "security") else F.lit("")).alias(c) for c in ("purpose", "behavior", "invariants", "security")])).alias("payload"))
        base = written(lookups.remaining(base, done, "unit_id"))
    told = written(told if told is not None else spark.createDataFrame([], "unit_id string, payload string"))

    def with_callees(rows: DataFrame, passes: int = 1) -> DataFrame:
        """rows dealt into the tasks that ask, so that their texts move once."""
        rows = rows.repartition(state.tasks(passes * rows.count()), "unit_id")
        called = calls.join(told.withColumnRenamed("unit_id", "callee"), "callee").groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("at", F.col("callee").alias("unit_id"), "payload"))).alias("called"))
        rows = rows.join(called, "unit_id", "left")
        return rows.withColumn("called", F.coalesce("called", none.cast("array<struct<at: int, unit_id: string, payload: string>>")))

    callees = F.transform("called", lambda c: F.struct(c["unit_id"].alias("unit_id"), F.from_json(c["payload"], TOLD).alias("summary"))).alias("callees")
    shape = [language, "functions", "receiver", callees, F.col("outside").alias("externals")]
    levels = [r[0] for r in base.select("level").distinct().orderBy("level").collect()]
    for level in levels:
        rows = with_callees(base.filter(F.col("level") == level))
        parts = F.concat(F.flatten(F.transform("functions", lambda f: F.array(f["body"], f["told"]))), F.transform("called", lambda c: c["payload"]))
        asked = rows.select(F.col("unit_id").alias("id"), F.lit("summary").alias("pass"), F.to_json(F.struct(*shape)).alias("context"), T.content_hash(F.array_join(parts, "")).alias("cache_key"))
        found = state.keep(f"level-{level}", asked, summaries, config.cache)
        told = written(told.unionByName(found.select(F.col("id").alias("unit_id"), "payload")))

    full = with_callees(base, sum(p.enabled and p.name != "summary" for p in config.passes)).join(told, "unit_id")
    names = spark.createDataFrame([(p.name, k, p.enabled) for k, p in enumerate(config.passes)], "pass string, ord int, enabled boolean")
    asked = lookups.with_passes(full.select(F.col("unit_id").alias("id"), F.to_json(F.struct(*shape, F.from_json("payload", TOLD).alias("summary"))).alias("context")), names)
    answers = state.keep("answers", asked, lambda rows, counts: _ask(rows, client, settings, "issues", counts))
    passes = F.broadcast(names.select("pass", F.col("ord").alias("pass_ord")))  # as many rows as passes configured
    issues = answers.join(passes, "pass").select(F.col("id").alias("unit_id"), "pass", "pass_ord", F.posexplode(F.from_json("payload", FOUND)["issues"]).alias("at", "i")).join(base.select("unit_id", "functions"), "unit_id")
    named = F.filter("functions", lambda f: f["name"] == F.col("i.function"))
    issues = issues.withColumn("f", F.coalesce(F.get(named, F.size(named) - 1), F.get("functions", F.lit(0))))
    start, line = F.col("f.position.Line"), F.col("i.line")
    hint = F.when(line > 0, line - start + 1).otherwise(0)
    at = T.locate_snippet(F.col("f.body"), F.col("i.code"), hint)
    place = F.when((F.col("i.code") != "") & (at > 0), start + at - 1).when((F.col("i.code") == "") & (line > 0), start + line - 1).otherwise(start)
    position = F.struct(F.col("f.position.Filename").alias("Filename"), F.col("f.position.Offset").alias("Offset"), place.alias("Line"), F.col("f.position.Column").alias("Column")).cast(POSITION)
    issues = issues.select("unit_id", (F.col("pass_ord") * 1_000_000 + F.col("at")).cast("int").alias("ord"), position.alias("position"), F.col("i.severity").alias("severity"), F.col("pass").alias("category"), F.col("i.message").alias("message"), F.lit("").alias("snippet"), F.col("i.suggestion").alias("suggestion"))
    made = F.transform("functions", lambda f: F.struct(f["package"].alias("package"), f["name"].alias("name"), f["receiver"].alias("receiver"), f["signature"].alias("signature"), f["position"].alias("position")))
    report_units = base.select("unit_id", F.col("level").alias("ordinal"), made.alias("functions")).join(told, "unit_id").select("unit_id", "ordinal", "functions", F.from_json("payload", TOLD).alias("s")).select("unit_id", "ordinal", "functions", "s.*")
    return written(report_units), written(issues)
