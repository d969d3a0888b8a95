"""Commands on a workspace: ingest, index, status, ask, brief, npt, patterns, eval."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataledger.operators import answers, briefs, evaluation, ledger, patterns
from strataledger.plans.archive import parse_files, stored
from strataledger.plans.settings import Settings, SettingsError, of_toml, resolve
from strataledger.sources import folder, warehouse
from strataledger.sources.storage import exists, read_text
from strataledger.sources.tables import Warehouse

# Exit codes of a brief that is not verified, and of one without exposure.
NOT_VERIFIED, NO_EXPOSURE = 2, 3


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strataledger", description=__doc__)
    top.add_argument("--root", required=True, help="folder of the workspace's tables")
    top.add_argument("--settings", help="a TOML file, in place of the workspace's own")
    top.add_argument("--set", action="append", default=[], metavar="TABLE.KEY=VALUE", help="a setting over all files")
    commands = top.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest")
    ingest.add_argument("folder")
    ingest.add_argument("--prune", action="store_true")
    ingest.add_argument("--dry-run", action="store_true")
    ingest.add_argument("--field", help="where documents are filed that name no field")
    commands.add_parser("index").add_argument("--rebuild", action="store_true")
    commands.add_parser("status")
    commands.add_parser("ask").add_argument("question")
    brief = commands.add_parser("brief")
    brief.add_argument("tenant")
    brief.add_argument("entity")
    brief.add_argument("depth", type=float)
    brief.add_argument("--rig")
    brief.add_argument("--tool")
    brief.add_argument("--markdown", action="store_true")
    npt = commands.add_parser("npt")
    npt.add_argument("--by", default="code", choices=ledger.DIMENSIONS)
    npt.add_argument("--since")
    commands.add_parser("patterns").add_argument("tenant")
    commands.add_parser("eval").add_argument("cases")
    return top


def thresholds(settings: Settings) -> patterns.Thresholds:
    r = settings.risk
    return patterns.Thresholds(r.min_wells, r.min_support, r.min_lift, r.equipment_min_ratio, r.equipment_min_rate, r.equipment_min_wells)


def run(spark: SparkSession, args: argparse.Namespace, settings: Settings) -> tuple[object, int]:
    """What a command prints, and its exit code."""
    house = Warehouse(spark, args.root.rstrip("/"))
    if args.command == "ingest":
        return warehouse.ingest(house, folder.scan(spark, args.folder), parse_files(settings, args.field), args.prune, args.dry_run), 0
    if args.command == "index":
        warehouse.build_index(house, settings.retrieval.k1, settings.retrieval.b, args.rebuild)
        return {"index": warehouse.index_hash(house)}, 0
    if args.command == "status":
        return [r.asDict() for r in warehouse.index_status(house, settings.retrieval.k1, settings.retrieval.b).orderBy("tenant").collect()], 0
    if args.command in ("ask", "eval"):
        warehouse.ensure_index(house, settings.retrieval.k1, settings.retrieval.b)
    archive = stored(house, settings)
    rate = settings.costs.spread_rate
    if args.command == "ask":
        found = answers.ask(archive, args.question, settings.retrieval.top_k, rate, settings.taxonomy.keywords)
        warehouse.log(house, "ask", {k: found[k] for k in ("question", "abstained", "plan")})
        return found, 0
    if args.command == "brief":
        try:
            found = briefs.build_brief(archive, args.entity, args.tenant, args.depth, rate, args.rig, args.tool, thresholds(settings), settings.risk.max_risks, keywords=settings.taxonomy.keywords)
        except briefs.MissingReports as error:
            return {"error": str(error)}, NO_EXPOSURE
        hashes = warehouse.corpus_hash(house.read("documents")).first().digest, warehouse.index_hash(house)
        found["provenance"] = briefs.provenance(found, "0.2", *hashes)
        warehouse.log(house, "brief", {k: found[k] for k in ("entity", "tenant", "verification")})
        return briefs.markdown(found) if args.markdown else found, 0 if found["verification"]["ok"] else NOT_VERIFIED
    if args.command == "npt":
        rows = ledger.filter_ledger(archive.ledger, since=args.since)
        return [r.asDict() for r in ledger.rollup(rows, [args.by], answers.AVOIDABLE, rate).orderBy(F.col("total_hours").desc(), args.by).collect()], 0
    if args.command == "patterns":
        own = archive.ledger.where(F.col("tenant") == args.tenant).withColumns({"report_id": F.col("doc_id"), "line": F.col("event_ord")})
        daily = archive.daily.where(F.col("tenant") == args.tenant)
        return [r.asDict() for r in patterns.find_patterns(daily, own, answers.AVOIDABLE, briefs.RIG_CODES, briefs.TOOL_CODES, thresholds(settings)).collect()], 0
    with open(args.cases, encoding="utf-8") as file:
        found = evaluation.run_cases(evaluation.load_cases(file.read()), archive)
    return found, 0 if found["all_gates"] else 1


def file_text(spark: SparkSession, path: str) -> str:
    """A small text file, empty where there is none."""
    return read_text(spark, path) if exists(spark, path) else ""


def settings_of(spark: SparkSession, args: argparse.Namespace, environ: Mapping[str, str]) -> Settings:
    """Command line over environment over the folder's file over the workspace's file over defaults."""
    if args.settings:
        with open(args.settings, encoding="utf-8") as file:
            own = file.read()
    else:
        own = file_text(spark, f"{args.root.rstrip('/')}/{folder.CONFIG}")
    below = file_text(spark, f"{args.folder.rstrip('/')}/{folder.CONFIG}") if args.command == "ingest" else ""
    return resolve(own, below, environ, of_toml("\n".join(args.set), "command line"))


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    import os

    args = parser().parse_args(argv)
    session = spark or SparkSession.builder.getOrCreate()
    try:
        settings = settings_of(session, args, os.environ)
    except (OSError, SettingsError) as error:
        print(error, file=sys.stderr)
        return 1
    if args.command not in ("ingest",) and not exists(session, args.root):
        print(f"no workspace at {args.root}", file=sys.stderr)
        return 1
    found, code = run(session, args, settings)
    print(found if isinstance(found, str) else json.dumps(found, default=str, indent=1))
    return code


if __name__ == "__main__":
    sys.exit(main())
