"""Command line: ``index``, ``init``, ``validate``."""

from __future__ import annotations

import argparse
import os
import sys

from .respond.core import BudgetExceeded, SetupError

# Exit codes: 0 done, 1 other failure, 2 out of budget, 3 no answers to be had.
TEMPLATES = {
    "config.yaml": "default_model: canned/none\nproviders: {}\n",
    "components.overrides.yaml": "schema_version: 1\npins: {}\nadditions: []\n",
    "subsystems.overrides.yaml": "schema_version: 1\nsubsystems: []\n",
}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodestone")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index", help="analyse a file tree")
    i.add_argument("root")
    i.add_argument("--out", default=None)
    i.add_argument("--max-depth", type=int, default=8)
    limit = i.add_mutually_exclusive_group(required=True)
    limit.add_argument("--budget", type=int)
    limit.add_argument("--no-budget", action="store_true")
    i.add_argument("--dry-run", action="store_true")
    i.add_argument("--no-overrides", action="store_true")
    i.add_argument("--no-gitignore", action="store_true")
    i.add_argument("--recarve", action="store_true", help="forget earlier components and give ids anew")
    i.add_argument("--parallel", type=int, help="calls at a time")
    i.add_argument("--stages", help="folder of digests and answers of rules that later runs reuse")
    i.add_argument("--quiet", action="store_true", help="don't tell what happens")
    n = sub.add_parser("init", help="write template files that aren't there")
    n.add_argument("folder")
    v = sub.add_parser("validate", help="check authored overrides")
    v.add_argument("folder")
    a = p.parse_args(argv)
    if a.command == "init":
        from .sources.tables import scaffold

        for name in scaffold(a.folder, TEMPLATES):
            print(f"wrote {name}")
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("lodestone").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "validate":
        return validate(spark, a.folder)
    from .plans.index import Options, index
    from .respond.progress import Narrator, Silent

    root = os.path.realpath(a.root)
    try:
        r = index(spark, root, a.out or os.path.join(root, ".lodestone"), options=Options(a.max_depth, a.budget, a.dry_run, not a.no_overrides, not a.no_gitignore, a.parallel, a.recarve, a.stages), progress=Silent() if a.quiet else Narrator())
    except BudgetExceeded as e:
        print(e, file=sys.stderr)
        return 2
    except SetupError as e:
        print(e, file=sys.stderr)
        return 3
    print(" ".join(f"{k}={v}" for k, v in r.summary.items() if k not in ("rounds", "hashed")))
    return 0


def validate(spark, folder: str) -> int:
    from .operators import project as J
    from .sources import tables as S

    over = S.load_yaml(os.path.join(folder, "components.overrides.yaml"), "overrides")
    subs = S.load_yaml(os.path.join(folder, "subsystems.overrides.yaml"), "subsystems")
    listed = spark.createDataFrame([(k, s.get("id"), s.get("members") or []) for k, s in enumerate(subs.get("subsystems", []))], "ord int, id string, members array<string>")
    issues = J.validate_pins(S.pins_table(spark, over)).union(J.validate_additions(S.table(spark, over.get("additions", []), S.COMPONENT))).union(J.validate_subsystems(listed)).cache()
    for r in J.report_lines(issues).collect():
        print(r["line"])
    last = J.tally(issues).first()
    print(last["line"] if last else "ok")
    errors = issues.where("severity = 'error'").count()
    return 1 if errors else 0


if __name__ == "__main__":
    sys.exit(main())
