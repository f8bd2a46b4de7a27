"""Reviews with a keyed client: order of levels, cache, resume, positions."""

import json
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from test_sources import index  # noqa: F401
from unitflow.functions import models
from unitflow.plans.extract import extract
from unitflow.plans.review import CACHE_PARTS, Config, Pass, State, _ask, forget, read_cache, remember, review, summaries

UNIT = "pkg/a.(Box).get+pkg/a.help"


def told(word):
    return json.dumps({"purpose": word, "behavior": "", "invariants": [], "security": []})


def test_review(spark, index, tmp_path):  # noqa: F811
    ex = extract(spark, index)
    issue = {"function": "help", "line": 0, "code": "  get()", "severity": "high", "message": "loops"}
    answers = {("type_summary", "pkg/a.Box"): told("boxes"), ("summary", UNIT): told("helps"), ("baseline", UNIT): json.dumps({"issues": [issue, issue | {"function": "?", "code": "", "line": 2}]})}
    config = Config(cache=str(tmp_path / "cache"), passes=[Pass("summary"), Pass("baseline"), Pass("security", enabled=False)])
    units, issues = review(spark, ex, models.KeyedClient(answers), config)
    assert [(r["unit_id"], r["purpose"], len(r["functions"])) for r in units.collect()] == [(UNIT, "helps", 2)]
    assert sorted((r["position"]["Line"], r["severity"], r["category"]) for r in issues.collect()) == [(3, "high", "baseline"), (8, "high", "baseline")]
    # with the cache, a client without summaries gives the same ones; a report made before leaves nothing to do
    again, _ = review(spark, ex, models.KeyedClient(), config)
    assert again.collect() == units.collect()
    rest, none = review(spark, ex, models.KeyedClient(), Config(), done=units)
    assert rest.count() == none.count() == 0


def noted(folder, fails=""):
    """A client that notes every request in a folder, and fails, slowly, at one of them. Made here, so that workers get it by value."""

    class Noted:
        def complete(self, request):
            if request["id"] == fails:
                time.sleep(4)
                raise RuntimeError("gone")
            with open(f"{folder}/{request['id']}", "a") as f:
                f.write("x")
            severity = "high" if request["id"].endswith("1") else "low"
            return json.dumps({"issues": [{"function": "f", "line": 0, "code": "", "severity": severity, "message": "m"}]})

    return Noted()


def test_answers_of_finished_tasks_stay_when_another_fails(spark, tmp_path):
    from unitflow.plans.prompts import load_inline

    (tmp_path / "asked").mkdir()
    ids = [f"u{k}" for k in range(40)]
    rows = spark.createDataFrame([(i, "p", json.dumps({"functions": []})) for i in ids], "id string, pass string, context string")
    settings = {"p": {"template": load_inline("Hello"), "llm": {}}}
    told = []
    config = Config(state=str(tmp_path / "state"), step=4, tally=lambda phase, n: told.append((phase, n)))
    ask = lambda client: lambda rest, counts: _ask(rest, client, settings, "issues", counts)
    with pytest.raises(Exception, match="gone"):
        State(spark, config).keep("answers", rows, ask(noted(str(tmp_path / "asked"), "u17")))
    kept = {r.id for r in spark.read.parquet(str(tmp_path / "state" / "answers")).collect()}
    assert len(kept) >= 20 and "u17" not in kept  # all tasks but the failed one, which had about four requests
    for f in (tmp_path / "asked").iterdir():
        f.unlink()
    found = State(spark, config).keep("answers", rows, ask(noted(str(tmp_path / "asked")))).collect()
    assert {r.id for r in found} == set(ids) and len(found) == 40
    assert {f.name for f in (tmp_path / "asked").iterdir()} == set(ids) - kept
    again = State(spark, config).keep("answers", rows, ask(noted(str(tmp_path / "asked"), "u1"))).count()
    assert again == 40 and all(f.read_text() == "x" for f in (tmp_path / "asked").iterdir())
    assert told[-1] == ("answers", dict(Counter("high" if i.endswith("1") else "low" for i in set(ids) - kept)))


def test_tally_ends_with_the_issues_found(spark, index):  # noqa: F811
    told = []
    issues = json.dumps({"issues": [{"function": "", "line": 0, "code": "", "severity": s, "message": "m"} for s in ("low", "low", "high")]})
    client = models.KeyedClient({}, {"summary": told_summary(), "issues": issues})
    _, found = review(spark, extract(spark, index), client, Config(passes=[Pass("summary"), Pass("baseline"), Pass("security")], tally=lambda phase, n: told.append((phase, n))))
    assert told[-1] == ("answers", {r.severity: r["count"] for r in found.groupBy("severity").count().collect()}) == ("answers", {"low": 4, "high": 2})


def test_summaries_can_be_looked_up(spark, index, tmp_path):  # noqa: F811
    answers = {("type_summary", "pkg/a.Box"): told("boxes"), ("summary", UNIT): told("helps")}
    review(spark, extract(spark, index), models.KeyedClient(answers), Config(state=str(tmp_path)))
    found = {(r.kind, r.id): r.purpose for r in summaries(spark, str(tmp_path)).collect()}
    assert found["type", "pkg/a.Box"] == "boxes" and found["unit", UNIT] == "helps"


def told_summary():
    return told("p")


def test_cache_reads_and_rewrites_only_the_parts_it_needs(spark, tmp_path):
    cache = str(tmp_path / "cache")
    keys = [f"key{k}" for k in range(600)]
    remember(spark.createDataFrame([(k, f"v {k}") for k in keys], "cache_key string, payload string"), cache)
    one = spark.createDataFrame([("key5",), ("no such key",)], "cache_key string")
    held = read_cache(spark, cache, one)
    assert 0 < held.count() < 600 * 6 / CACHE_PARTS * 2 + 20 and [r.payload for r in held.filter("cache_key = 'key5'").collect()] == ["v key5"]
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part#" in plan and " IN (" in plan.partition("PartitionFilters")[2][:40]
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "cache").rglob("*.parquet")}
    forget(spark, cache, one)
    assert {r.cache_key for r in read_cache(spark, cache).collect()} == set(keys) - {"key5"}
    same = sum(f.exists() and f.stat().st_mtime_ns == at for f, at in files.items())
    assert same >= len(files) - 2
    forget(spark, cache, spark.createDataFrame([(k,) for k in keys], "cache_key string"))
    assert read_cache(spark, cache).count() == 0 and read_cache(spark, cache, one).filter(F.col("payload").isNotNull()).isEmpty()


def test_answers():
    assert models.decoded('{"purpose": "p"}', "summary") == {"purpose": "p", "behavior": "", "invariants": [], "security": []}
    with pytest.raises(ValueError, match="no json"):
        models.decoded("no json", "issues")
    assert models.display("", "a\n```ts\nf(x)\n```\nb") == ("f(x)", "a\nb")
    assert models.display("s", "```\nx\n```") == ("s", "```\nx\n```") and models.display("", "``````") == ("", "``````")
