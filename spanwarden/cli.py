"""Command line: scan, eval run, eval render, and serve over files of crossings.

Exit codes of scan: 0 clean, 1 findings, 2 error. Of eval run: 0 passed, 1 below a threshold, 2 classes
without both kinds of entries or an error.
"""

from __future__ import annotations

import argparse
import hashlib
import sys

from pyspark.sql import SparkSession

from .operators import crossings, evaluation
from .operators.policy import Config, load_config
from .rules import SHIPPED, RuleError, load_rules
from .sources import files


def _rules(folder: str | None):
    return load_rules(folder) if folder else list(SHIPPED)


def startup_rules(config: Config, folder: str | None):
    """Rules at start-up: they may be missing only where the policy doesn't need them."""
    try:
        return _rules(folder)
    except RuleError:
        if config.requires_rules:
            raise
        return []


def scan(spark: SparkSession, args) -> int:
    results = files.scan_paths(spark, args.paths or ["."], _rules(args.rules)).cache()
    for line in files.print_json(results) if args.json else files.print_text(results):
        print(line)
    return int(not files.dirty(results).isEmpty())


def run_eval(spark: SparkSession, args) -> int:
    rules = _rules(args.rules)
    corpus = evaluation.load_corpus(spark, args.corpus)
    scored = evaluation.evaluate_corpus(corpus, rules).cache()
    print("\n".join(evaluation.report(scored, note=args.command == "render")))
    if args.command == "render":
        return 0
    missing = [r["class"] for r in evaluation.uncovered(spark, rules, corpus).collect()]
    if missing:
        print("without positive and negative entries: " + ", ".join(missing), file=sys.stderr)
        return 2
    failed = evaluation.gate(scored, evaluation.thresholds(spark, rules), args.min_precision, args.min_recall).collect()
    for r in failed:
        print(f"below threshold: {r['class']} precision {r.precision:.3f} (least {r.min_precision:.3f}) recall {r.recall:.3f}", file=sys.stderr)
    return int(bool(failed))


def serve(spark: SparkSession, args) -> int:
    """Reads crossings as Parquet and writes their results, then the evidence of what was written.

    A run is named after its input unless it is given a name, and writes in place of an earlier attempt of
    the same name, so a run that failed midway is repeated without loss or doubles. Evidence goes to
    --ledger, else to the policy's logger.output; stdout prints it."""
    config = load_config(args.config)
    run = args.run_name or hashlib.sha256(args.crossings.encode()).hexdigest()[:12]
    path, rules = f"{args.out.rstrip('/')}/run={run}", startup_rules(config, args.rules)
    given = spark.read.parquet(args.crossings)
    crossings.serve_requests(given, config, rules).drop("direction").write.mode("overwrite").parquet(f"{path}/direction=request")
    asked = spark.read.parquet(f"{path}/direction=request")
    crossings.serve_responses(given, asked, config, rules).drop("direction").write.mode("overwrite").parquet(f"{path}/direction=response")
    entries = crossings.evidence(spark.read.parquet(path))
    target = args.ledger or config.output
    if target == "stdout":
        for r in files.ledger_lines(entries).toLocalIterator():
            print(r.value)
    else:
        files.put_ledger(entries, target, run)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spanwarden", description=__doc__)
    sub = top.add_subparsers(dest="plane", required=True)
    s = sub.add_parser("scan")
    s.add_argument("paths", nargs="*")
    s.add_argument("--rules")
    s.add_argument("--json", action="store_true")
    s.set_defaults(run=scan)
    e = sub.add_parser("eval")
    e.add_argument("command", choices=["run", "render"])
    e.add_argument("--rules")
    e.add_argument("--corpus", required=True)
    e.add_argument("--min-precision", type=float, default=0.80)
    e.add_argument("--min-recall", type=float, default=0.80)
    e.set_defaults(run=run_eval)
    v = sub.add_parser("serve")
    v.add_argument("--config", default="policy.yaml")
    v.add_argument("--rules")
    v.add_argument("--crossings", required=True)
    v.add_argument("--out", required=True)
    v.add_argument("--ledger")
    v.add_argument("--run-name")
    v.set_defaults(run=serve)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("spanwarden").getOrCreate()
    try:
        return args.run(spark, args)
    except Exception as e:  # noqa: BLE001  the exit code says it; messages of rules and files hold no values
        print(f"error: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
