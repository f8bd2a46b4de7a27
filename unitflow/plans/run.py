"""A whole review: configuration, extraction, model calls, report; and its command line."""

from __future__ import annotations

import argparse
import datetime
import hashlib
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from unitflow.functions.models import Client, HttpClient
from unitflow.functions.tables import written
from unitflow.operators import lookups
from unitflow.plans import config, report
from unitflow.plans.extract import Extracted, extract
from unitflow.plans.packages import extract_go
from unitflow.plans.review import review


def merged(old: tuple[DataFrame, DataFrame], new: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Units and issues of two reports; of a unit in both, the new one's."""
    return tuple(lookups.remaining(a, new[0], "unit_id").unionByName(b.select(*a.columns)) for a, b in zip(old, new))


def run(spark: SparkSession, settings: config.Settings, ex: Extracted, client: Client, form: str = "all", resume: bool = False, prompts: str = "", state: str = "", metadata: dict | None = None) -> dict:
    """Reviews and writes the report; returns it. With resume, units of the JSON report that is there are kept as they are, and steps
    that a stopped run finished are read from the state folder; without it, both are begun anew."""
    old = None
    if resume and settings.output.get("json") and Path(settings.output["json"]).exists():
        old = report.read_json(spark, settings.output["json"])
    asked = settings.review(prompts, state)
    asked.progress = lambda phase, n: print(f"    {phase}: {n}", flush=True)
    units, issues = review(spark, ex, client, asked, old[0] if old else None)
    if old:
        units, issues = (written(t) for t in merged(old, (units, issues)))
    made = report.assemble(units, issues, {"generated_at": datetime.datetime.now(datetime.timezone.utc).isoformat()} | (metadata or {}))
    report.write_report(made, form, settings.output)
    return made


def arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="unitflow", allow_abbrev=False)
    command = parser.add_subparsers(dest="command", required=True).add_parser("run", allow_abbrev=False)
    command.add_argument("-config", "--config", action="append", help="configuration file or glob; again for more")
    command.add_argument("-c", "--c", action="append", default=[], dest="inline", help="inline configuration; again for more")
    command.add_argument("-format", "--format", default="all", choices=["json", "markdown", "sarif", "all"])
    command.add_argument("-resume", "--resume", action="store_true", help="go on from the report and steps that are there")
    command.add_argument("-prompts", "--prompts", default="", help="folder to read builtin prompts from")
    command.add_argument("-scip", "--scip", default="", help="code index; without one, Go source under the root")
    command.add_argument("-root", "--root", default="", help="project root, in place of the index's or of the working folder")
    command.add_argument("patterns", nargs="*", help="globs of paths, or Go packages, to review")
    found = parser.parse_args(argv)
    found.config = found.config or ["unitflow.cue"]
    found.patterns = found.patterns or ([] if found.scip else ["./..."])
    return found


def main(argv: list[str] | None = None, client: Client | None = None) -> int:
    found = arguments(sys.argv[1:] if argv is None else argv)
    try:
        settings = config.load(found.config, found.inline)
    except ValueError as error:
        print(f"load config: {error}", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("unitflow").getOrCreate()
    print("Extracting analysis units...")
    ex = extract(spark, found.scip, found.patterns, root=found.root) if found.scip else extract_go(spark, found.root or os.getcwd(), found.patterns)
    print(f"Created {ex.units.count()} analysis units ({ex.externals.count()} external functions, {ex.types.count()} types)")
    for row in ex.warnings.toLocalIterator():
        print(row[0], file=sys.stderr)
    of = hashlib.sha256(repr((found.scip, found.root, found.patterns, settings.passes, settings.llm["model"], found.prompts)).encode()).hexdigest()[:16]
    state = f"{settings.cache_dir}-steps/{of}" if settings.cache_enabled else ""
    if state and not found.resume:
        path = spark._jvm.org.apache.hadoop.fs.Path(state)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    client = client or HttpClient(settings.llm["base_url"], settings.llm["api_key"])
    about = {"modules": found.patterns, "config_files": found.config} | ({"inline_configs": found.inline} if found.inline else {})
    made = run(spark, settings, ex, client, found.format, found.resume, found.prompts, state, about)
    print(f"\nAnalysis complete: {made['summary']['total_issues']} issues found")
    for severity, n in made["summary"]["by_severity"].items():
        print(f"  {severity}: {n}")
    return 0
