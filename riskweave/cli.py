"""Command line: ``python -m riskweave.cli check SOURCE [options]``."""

from __future__ import annotations

import argparse
import contextlib
import json
import shutil
import sys
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from riskweave.functions.catalog import CatalogError, read_catalog, risk_catalog
from riskweave.functions.urls import UnsafeGitUrlError
from riskweave.plans import scan as plan
from riskweave.sources import tree
from riskweave.sources.shared import shared_folder


def run_check(args: argparse.Namespace) -> int:
    """0 passed, 2 bad source or threshold, 3 nothing to scan, 4 breached."""
    try:
        threshold = plan.parse_threshold(args.fail_on)
        catalog = read_catalog(args.catalog) if args.catalog else None
    except (plan.ThresholdError, CatalogError) as e:
        print(e, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("riskweave").getOrCreate()
    with contextlib.ExitStack() as stack:
        try:
            work = Path(shared_folder(spark) if "://" in args.source or args.source.startswith("git@") else "")  # where a clone goes
            if work.name:
                stack.callback(shutil.rmtree, work, ignore_errors=True)
            root = tree.resolve(args.source, work)
        except (OSError, tree.UnsafeZipError, tree.IngestError, UnsafeGitUrlError) as e:
            print(f"{args.source}: {e}", file=sys.stderr)
            return 2
        try:
            found = plan.scan_directory(spark, str(root))
        except (PySparkException, plan.UnreadFileError) as e:  # a file that can't be read may hold what the gate looks for
            print(f"{args.source}: {e}", file=sys.stderr)
            return 2
        if plan.risk.is_empty_scan(found.facts, found.confidence):
            print("nothing to scan was found", file=sys.stderr)
            return 3
        known = risk_catalog(spark, catalog)
        register = plan.risk.register(known, found.operations, found.findings).persist()
        rows, gate = register.collect(), plan.risk.verdict(register, threshold).first()
        operations, findings = found.operations.count(), found.findings.count()
        if args.summary_md:
            with open(args.summary_md, "a", encoding="utf-8") as f:
                f.write(plan.markdown(rows, gate, found.framework, operations, findings, args.source) + plan.findings_text(rows))
        if args.sarif:
            plan.write_sarif_log(register, plan.risk.evidence_rows(known, found.operations, found.findings), args.sarif)
        if args.scan_out:
            plan.write_artifact(plan.artifact(spark, found, args.source, args.redact), args.scan_out)
        found.release()
        register.unpersist()
    counts = plan.counts_of(rows)
    if args.json:
        out = {"framework": found.framework, "operations": operations, "pii_findings": findings, "counts": counts, "total": gate["total"], "worst": gate["worst"], "threshold": threshold, "breached": gate["breached"]}
        if args.scan_out:
            out |= {"scan_out": args.scan_out, "redacted": args.redact}
        print(json.dumps(out, ensure_ascii=False))
    else:
        for level, n in reversed(counts.items()):
            print(f"{level}: {n}")
        if gate["breached"]:
            print(f"{gate['worst']} >= {threshold}", file=sys.stderr)
    return gate["exit_code"]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="riskweave")
    commands = parser.add_subparsers(dest="command")
    check = commands.add_parser("check", help="scan a folder, a zip or a https repository")
    check.add_argument("source")
    check.add_argument("--fail-on", default="none")
    check.add_argument("--catalog", help="a JSON file of risks instead of the bundled catalog")
    check.add_argument("--summary-md")
    check.add_argument("--sarif")
    check.add_argument("--scan-out")
    check.add_argument("--redact", action="store_true")
    check.add_argument("--json", action="store_true")
    args = parser.parse_args(argv)
    return run_check(args) if args.command == "check" else 1


if __name__ == "__main__":
    sys.exit(main())
