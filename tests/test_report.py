"""Evaluation runs, result files, trend; summaries of agents' steps."""

import os

import yaml
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.plans import report
from lodestone.sources import tables as S


def component(i, path, kind="service", **more):
    return {"id": i, "kind": kind, "path_segments": [{"path": path, "content_sha": "s" + i}], "manifests": [], "evidence_fields": [], "deleted": False} | more


def write(folder, components, edges=()):
    os.makedirs(folder, exist_ok=True)
    S.write_yaml(f"{folder}/components.yaml", {"schema_version": 1, "components": components})
    S.write_yaml(f"{folder}/related-components.yaml", {"schema_version": 2, "edges": list(edges)})


def test_evaluation(spark, tmp_path):
    root, out, gold = (str(tmp_path / n) for n in ("root", "out", "gold"))
    os.makedirs(f"{root}/a")
    with open(f"{root}/a/Cargo.toml", "w") as f:
        f.write("[lib]\n")
    edge = {"kind": "calls", "lifecycle": "runtime", "participants": ["a", "ghost"], "evidence_grade": "weak", "evidence_fields": [], "rationale": "r"}
    write(out, [component("a", "a"), component("b", "a/b")], [edge])
    write(gold, [component("g", "a"), component("h", "elsewhere", kind="website")])
    r = report.evaluate(spark, out, root, "t", "2026-01-01", gold, rounds=9)
    assert r["metrics"]["component_coverage"] == 0.5 and r["metrics"]["spurious_rate"] == 0.5 and r["metrics"]["kind_accuracy"] == 1
    assert r["metrics"]["edge_recall"] == 1 and r["metrics"]["edge_precision"] == 0
    assert {c["name"] for c in r["invariants"] if not c["passed"]} == {"no_path_overlap", "manifest_coverage", "edge_participants", "termination"}
    write(out, [component("a", "a", manifests=["a/Cargo.toml"]), component("b", "a/b", parent="a")])
    r2 = report.evaluate(spark, out, root, "t<", "2025-01-01")
    assert r2["metrics"] is None and all(c["passed"] for c in r2["invariants"])
    results = tmp_path / "results"
    results.mkdir()
    (results / "1.yaml").write_text(yaml.safe_dump(r))
    (results / "2.yaml").write_text(yaml.safe_dump(r2))
    (results / "3.yaml").write_text("{")
    page = report.trend(str(results))
    assert page.index("2025-01-01") < page.index("2026-01-01") and "t&lt;" in page and "Skipped: 3.yaml" in page and "7/7 passed" in page


def test_step_summaries(spark):
    df = spark.createDataFrame([("Read", '{"file_path":"a.rs"}'), ("Bash", "{"), ("Other", '{"command":"x"}')], "t string, j string")
    assert [r[0] for r in df.select(T.tool_summary(F.col("t"), F.col("j"))).collect()] == ["a.rs", "", ""]
    df = spark.createDataFrame([('/bin/zsh -lc "ls -a"',), ("/bin/zsh -lc 'x'",), (" ls ",), ("/bin/zsh -lc ls",)], "c string")
    assert [r[0] for r in df.select(T.shell_summary(F.col("c"))).collect()] == ["ls -a", "x", "ls", "ls"]
    df = spark.createDataFrame([('{"content":[{"text":"```json\\n{}\\n```"}]}',), ('{"choices":[{"message":{"content":"y"}}]}',)], "b string")
    assert [r[0] for r in df.select(T.provider_text(F.col("b"))).collect()] == ["{}", "y"]
