"""python -m assayer check TARGET... | tools | call NAME [JSON]"""

from __future__ import annotations

import argparse
import sys

USAGE = 3


def main(argv: list[str] | None = None, spark=None) -> int:
    from assayer import engine, settings, tools
    from assayer.operators import reports

    p = argparse.ArgumentParser(prog="assayer")
    commands = p.add_subparsers(dest="command", required=True)
    c = commands.add_parser("check")
    c.add_argument("targets", nargs="+")
    for name in ("--runtime", "--runtime-version", "--expected-sha256", "--explain", "--json-path", "--config", "--bundle"):
        c.add_argument(name)
    c.add_argument("--format", choices=("terminal", "json", "sarif", "markdown", "agent"))
    for name in ("--full-hash", "--summary-only", "--include-observations"):
        c.add_argument(name, action="store_true", default=None)
    c.add_argument("--tool", action="append", default=[], choices=("modelaudit", "picklescan", "fickling", "modelscan"))
    commands.add_parser("tools")
    k = commands.add_parser("call")
    k.add_argument("name")
    k.add_argument("arguments", nargs="?", default="{}")
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return USAGE if e.code else 0
    if a.command == "tools":
        print(tools.manifest())
        return 0
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
    if a.command == "call":
        answer = tools.invoke(spark, a.name, a.arguments)
        print(tools.render(answer))
        return USAGE if "error" in answer else 0
    try:
        own = settings.merge(settings.load(a.config), **{n: getattr(a, n) for n in ("runtime", "runtime_version", "expected_sha256", "explain", "json_path", "format", "full_hash", "summary_only", "include_observations")})
        bundle = None
        if a.bundle:
            from assayer.sources import knowledge

            bundle = knowledge.load(a.bundle)
        report = engine.check(spark, a.targets, own.runtime, own.runtime_version, own.expected_sha256, own.full_hash, bundle, a.tool)
    except (ValueError, OSError) as e:
        print(f"assayer: {e}", file=sys.stderr)
        return USAGE
    if own.json_path:
        whole = reports.projection(report) | ({"observations": report["observations"]} if own.include_observations else {})
        text = reports.canonical(whole)
        sys.stdout.write(text) if own.json_path == "-" else reports.write_atomically(text, own.json_path)
    if own.explain:
        one = next((f for f in report["findings"] if f["id"] == own.explain), None)
        print(reports.canonical(one) if one else f"no finding {own.explain}")
    elif own.summary_only:
        print(report["verdict"])
    elif own.json_path != "-":
        shown = {"terminal": reports.terminal, "markdown": lambda r: reports.markdown(r, bool(own.include_observations)), "sarif": lambda r: reports.canonical(reports.sarif(r)), "agent": lambda r: reports.canonical(reports.agent(r)), "json": lambda r: reports.canonical(reports.projection(r))}
        print(shown[own.format](report))
    return report["exit_code"]


if __name__ == "__main__":
    sys.exit(main())
