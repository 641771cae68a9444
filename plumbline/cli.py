"""Command line: policy, resolve, baseline, check, demo, history, impact and what-if over a recorded graph."""

from __future__ import annotations

import argparse
import sys

from plumbline.operators.policy import PolicyError, load_policy


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("plumbline").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _catalog(spark, args):
    from plumbline.sources import recorded

    return recorded.load(spark, args.graph, args.state)


def _models(spark, names):
    return spark.createDataFrame([(n,) for n in names], "model_urn string")


def main(argv: list[str] | None = None) -> int:
    """Runs a command and returns its exit code: 0, 1 for a block or a breaking impact, 2 for an error."""
    parser = argparse.ArgumentParser(prog="plumbline")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name, *options, graph=True):
        p = commands.add_parser(name)
        p.add_argument("--config", default="plumbline.yaml")
        if graph:
            p.add_argument("--graph", required=True)
            p.add_argument("--state", default="after")
        for flags, more in options:
            p.add_argument(*flags, **more)
        return p

    model = (["--model"], {"action": "append", "default": []})
    command("policy-validate", graph=False)
    command("policy-show", graph=False)
    command("resolve", model)
    command("baseline", model, (["--baseline"], {"required": True}))
    places = (["--baseline"], {"default": [], "action": "append", "help": "a place of baselines; the first that has a model's counts"})
    records = (["--records"], {"help": "JSON lines of the catalog's properties and notes, for models whose baseline is in none of the places"})
    switches = [([f"--{s}"], {"action": "store_true"}) for s in ("all", "require-baseline", "fail-on-warn", "markdown", "counters")]
    command("check", model, places, records, (["--write-back"], {}), *switches)
    command("demo", graph=False)
    command("history", model, (["--runs"], {"required": True}), (["--limit"], {"type": int, "default": 20}), graph=False)
    only = [([f"--{s}"], {"help": f"only tables of this {s}"}) for s in ("platform", "env")]
    narrow = (["--columns"], {"action": "store_true", "help": "only models that the lost columns feed, by column lineage"})
    command("impact", (["files"], {"nargs": "+"}), (["--fail-on-impact"], {"action": "store_true"}), (["--max-hops"], {"type": int, "default": 6}), *only, narrow)
    command("what-if", (["urn"], {}), (["column"], {}), (["--max-hops"], {"type": int, "default": 6}))
    args = parser.parse_args(argv)
    try:
        policy = load_policy(args.config).validate()
    except PolicyError as e:
        print(e, file=sys.stderr)
        return 2
    if args.command == "policy-validate":
        print(f"{len(policy.rules)} rule(s), {len(policy.exemptions)} exemption(s)")
        return 0
    if args.command == "policy-show":
        for kind, severity, confidence, source in policy.table():
            print(f"{kind:28} {severity:6} {confidence:9} {source}")
        return 0
    return _run(args, policy)


def _run(args, policy) -> int:
    from pyspark.sql import functions as F

    from plumbline.operators import impact, verdict
    from plumbline.plans import gate, report
    from plumbline.sources import documents, sinks

    spark = _session()
    if getattr(args, "all", False) and args.model:
        print("name models or ask for all, not both", file=sys.stderr)
        return 2
    names = getattr(args, "model", None) or list(policy.models)
    if args.command == "demo":
        return _demo(spark)
    if args.command == "history":
        runs = verdict.recent(verdict.runs_of(spark.read.parquet(args.runs)).filter(F.col("model_urn").isin(names)), args.limit)
        for row in verdict.history_summary(runs).orderBy("model_urn").collect():
            print(f"{report.short(row['model_urn'])}: {row['summary']}")
        for line in report.suggestion_lines(verdict.calibrate(runs).orderBy(F.desc("rate"), "kind").collect()):
            print(line)
        return 0
    catalog = _catalog(spark, args)
    if args.command in ("impact", "what-if"):
        owners = catalog.assets.select("urn", "owners")
        if args.command == "what-if":
            for row in impact.what_if(spark, args.urn, args.column, catalog.edges, owners, args.max_hops).orderBy("model_urn").collect():
                print(f"{report.short(row['model_urn'])} via {row['route']}")
            return 0
        tables = impact.tables_of(catalog.columns, args.platform, args.env)
        column_edges = catalog.column_edges if args.columns else None
        found = impact.sql_impact(spark, impact.read_statements(args.files), tables, catalog.edges, owners, args.max_hops, column_edges).orderBy("sql_file").collect()
        print(report.impact_comment(found))
        return int(args.fail_on_impact and any(r["breaking"] for r in found))
    if not names and not getattr(args, "all", False):
        print("no model is named", file=sys.stderr)
        return 2
    models = _models(spark, names)
    if args.command in ("resolve", "baseline"):
        found, snapshot = gate.resolve(catalog, models, policy.max_hops)
        counts = {r["model_urn"]: r["count"] for r in found.groupBy("model_urn").count().collect()}
        if any(counts.get(n, 0) <= 1 for n in names):
            print("a footprint has no assets beside the model", file=sys.stderr)
            return 2
        if args.command == "baseline":
            sinks.write_baseline(snapshot, args.baseline)
        for row in found.orderBy("model_urn", "depth", "place").collect():
            print(f"{'  ' * row['depth']}{row['urn']}")
        return 0
    if args.all:
        models = catalog.assets.filter("entity_type = 'mlModel'").select(F.col("urn").alias("model_urn"))
    kept = [sinks.read_baseline(spark, place) for place in args.baseline]
    if args.records:
        kept.append(documents.from_records(spark.read.schema(documents.RECORDS).json(args.records)))
    if not kept:
        print("no place of baselines is named", file=sys.stderr)
        return 2
    baseline = sinks.first_of(kept)
    result = gate.check(catalog, models, baseline, policy, fail_on_warn=args.fail_on_warn, require_baseline=args.require_baseline)
    return _report(args, policy, result)


def _demo(spark) -> int:
    """The built-in graph under each of its changes; exits with the worst code."""
    from plumbline.plans import demo

    rows = demo.verdict_table(spark).orderBy("mutation", "model_urn").collect()
    for r in rows:
        print(f"{r['mutation']:12} {r['status']:6} {r['blocking']} blocking, {r['warning']} warning  {r['model_urn']}")
    return max(r["exit_code"] for r in rows)


def impact_table(urn):
    """The name under which a dataset is found in SQL."""
    from plumbline.functions.exprs import report_name

    return report_name(urn)


def _report(args, policy, result) -> int:
    from datetime import UTC, datetime

    from plumbline.operators import verdict
    from plumbline.plans import report
    from plumbline.sources import sinks

    if args.write_back:
        sinks.write_back(result.verdicts, result.findings, args.write_back, datetime.now(UTC))
    coverage = {r["model_urn"]: r for r in result.coverage.collect()}
    explained = {r["model_urn"]: r["explanation"] for r in verdict.explain(result.verdicts, result.findings).collect()}
    cut_short: dict[str, list[str]] = {}
    for r in result.footprint.filter("truncated").select("model_urn", "urn").collect():
        cut_short.setdefault(r["model_urn"], []).append(r["urn"])
    findings: dict[str, list] = {}
    for f in result.findings.orderBy("model_urn", "place").collect():
        findings.setdefault(f["model_urn"], []).append(f)
    for v in result.verdicts.orderBy("model_urn").collect():
        own = findings.get(v["model_urn"], [])
        if args.markdown:
            print(report.markdown(v, own, report.narrate(v, explained[v["model_urn"]])))
        else:
            print(report.console(v, own, coverage.get(v["model_urn"]), report.truncation_line(cut_short.get(v["model_urn"], []), policy.max_hops)))
    if args.counters:
        print("walk: " + ", ".join(f"{name} {n}" for name, n in result.walked.items()), file=sys.stderr)
    for incident in verdict.ordered_incidents(result.incidents).collect():
        print("\n".join(report.incident_lines(incident)))
    return result.exit_code()


if __name__ == "__main__":
    sys.exit(main())
