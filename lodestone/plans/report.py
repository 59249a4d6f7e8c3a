"""Evaluation of a run: invariants, metrics against a golden, result files and their trend."""

from __future__ import annotations

import html
import os
from collections.abc import Callable
from dataclasses import dataclass

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edges as D
from ..operators import enumerate as E
from ..operators import evaluate as V
from ..operators import tree as T
from ..sources import files as FS
from ..sources import tables as S

# Manifests that the coverage check looks for, and the most rounds of carving it accepts.
CHECKED_MANIFESTS = ("Cargo.toml", "package.json", "pyproject.toml", "go.mod")
MOST_ROUNDS = 8

COLUMNS = (("component_coverage", "Component coverage"), ("spurious_rate", "Spurious rate"), ("kind_accuracy", "Kind accuracy"), ("edge_precision", "Edge precision"), ("edge_recall", "Edge recall"), ("identifier_stability", "ID stability"))


@dataclass
class Run:
    components: DataFrame
    externals: DataFrame
    edges: DataFrame

    def flat(self) -> DataFrame:
        """Live components with their paths and place in the file."""
        c = self.components.where("not coalesce(deleted, false)")
        return c.withColumn("paths", F.col("path_segments.path")).withColumn("ord", F.monotonically_increasing_id())

    def keys(self) -> DataFrame:
        return D.canonical(self.edges).select(D.edge_key().alias("key"))


def load(spark: SparkSession, folder: str, prefix: str = "") -> Run:
    """A run's files; a golden's may have ``golden-`` before their names or not."""

    def rows(name: str, kind: str, key: str) -> list[dict]:
        path = os.path.join(folder, prefix + name)
        return S.load_yaml(path if prefix and os.path.exists(path) else os.path.join(folder, name), kind).get(key) or []

    return Run(S.table(spark, rows("components.yaml", "components", "components"), S.COMPONENT), S.table(spark, rows("external-components.yaml", "externals", "externals"), S.EXTERNAL), S.table(spark, rows("related-components.yaml", "related", "edges"), S.EDGE))


def metrics(golden: Run, tool: Run, earlier: Run | None = None, threshold: float = 0.5) -> dict:
    g, t = golden.flat(), tool.flat()
    pr = V.precision_recall(golden.keys(), tool.keys()).first()
    stable = V.identifier_stability(earlier.flat(), t).first()[0] if earlier else None
    return {"component_coverage": V.coverage(g, t, threshold).first()[0], "spurious_rate": V.spurious_rate(g, t, threshold).first()[0], "kind_accuracy": V.kind_accuracy(g, t, threshold).first()[0], "edge_precision": pr["precision"], "edge_recall": pr["recall"], "identifier_stability": stable}


def invariants(spark: SparkSession, run: Run, root: str, rounds: int | None = None, earlier: Run | None = None) -> list[dict]:
    """``name, passed, detail`` of the seven checks; one that lacks its input is skipped and says so."""
    c = run.flat()
    files = FS.with_text(FS.read_tree(spark, root))
    found = E.manifests_in(files).where(F.substring_index("path", "/", -1).isin(*CHECKED_MANIFESTS) & ~F.col("path").rlike(r"(^|/)\."))
    segments = c.select("id", F.explode("paths").alias("path"))
    known = c.select("id").union(run.externals.select("id"))
    participants = D.canonical(run.edges).select(D.edge_key().alias("key"), "participants")
    checks: list[tuple[str, Callable[[], DataFrame] | None]] = [
        ("path_coverage", lambda: V.empty_paths(c)),
        ("no_path_overlap", lambda: V.path_overlaps(segments, T.closure(c.select("id", "parent")))),
        ("manifest_coverage", lambda: V.uncovered_manifests(found, c)),
        ("git_rationale", lambda: V.missing_git_rationale(c, E.git_boundaries(files))),
        ("edge_participants", lambda: V.unknown_participants(participants, known)),
        ("rename_round_trip", (lambda: V.broken_round_trips(_shas(earlier), _shas(run))) if earlier else None),
    ]
    out = []
    for name, violations in checks:
        if violations is None:
            out.append({"name": name, "passed": True, "detail": "skipped"})
            continue
        bad = violations().limit(3).collect()
        out.append({"name": name, "passed": not bad, "detail": "; ".join(str(r.asDict()) for r in bad)})
    out.append({"name": "termination", "passed": rounds is None or rounds <= MOST_ROUNDS, "detail": "skipped" if rounds is None else f"{rounds} rounds"})
    return out


def _shas(run: Run) -> DataFrame:
    return run.flat().select("id", "ord", F.explode("path_segments.content_sha").alias("content_sha")).where("content_sha <> ''")


def evaluate(spark: SparkSession, out_dir: str, root: str, target: str, now: str, golden_dir: str | None = None, rounds: int | None = None) -> dict:
    """A result file's content; without a golden, invariants only."""
    run = load(spark, out_dir)
    golden = load(spark, golden_dir, "golden-") if golden_dir else None
    return {"generated_at": now, "target": target, "metrics": metrics(golden, run) if golden else None, "invariants": invariants(spark, run, root, rounds), "notes": None if golden else "no golden; structural invariants only"}


def summary(checks: list[dict]) -> str:
    failed = sorted(c["name"] for c in checks if not c["passed"])
    return "failed: " + ", ".join(failed) if failed else f"{len(checks)}/{len(checks)} passed"


def trend(folder: str) -> str:
    """An HTML table of a folder's result files by date; those that can't be read are named below it."""
    results, skipped = [], []
    for name in sorted(os.listdir(folder)):
        if not name.endswith((".yaml", ".yml")):
            continue
        try:
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                r = yaml.safe_load(f)
            results.append((str(r["generated_at"]), r["target"], r.get("metrics"), summary(r["invariants"])))
        except (yaml.YAMLError, KeyError, TypeError):
            skipped.append(name)
    cell = lambda x: "—" if x is None else f"{x:.3f}"
    head = "".join(f"<th>{html.escape(h)}</th>" for h in ("Date", "Target", *(c for _, c in COLUMNS), "Invariants"))
    rows = []
    for at, target, m, said in sorted(results):
        kind = ' class="fail"' if said.startswith("failed") else ' class="no-golden"' if m is None else ""
        values = [html.escape(at), html.escape(str(target)), *(cell((m or {}).get(k)) for k, _ in COLUMNS), html.escape(said)]
        rows.append(f"<tr{kind}>" + "".join(f"<td>{v}</td>" for v in values) + "</tr>")
    foot = f"<p>Skipped: {html.escape(', '.join(skipped))}</p>" if skipped else ""
    return f"<!DOCTYPE html><html><body><h1>Evaluation trend</h1><table><tr>{head}</tr>{''.join(rows)}</table>{foot}</body></html>\n"
