"""YAML, JSON and JSONL sources and sinks. These files are small and authored or read by people; tables go to Parquet."""

from __future__ import annotations

import json
import os
import re
import uuid
from datetime import UTC, datetime

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The version that each kind of file must state.
VERSIONS = {"components": 1, "externals": 1, "subsystems": 1, "overrides": 1, "related": 2}

COMPONENT = "id string, parent string, kind string, lifecycle_roles array<string>, language string, build_system string, role string, path_segments array<struct<path:string,content_sha:string>>, manifests array<string>, doc_anchors array<struct<path:string,heading:string>>, evidence_grade string, evidence_fields array<string>, rationale string, deleted boolean"
EDGE = "kind string, lifecycle string, participants array<string>, evidence_grade string, evidence_fields array<string>, rationale string"
EXTERNAL = "id string, kind string, language string, purl string, homepage string, url string, discovered_from array<string>, evidence_grade string"
PIN = "key string, field string, variant string, value string, children array<string>"
SUBSYSTEM = "id string, role string, lifecycle_roles array<string>, rationale string, evidence_grade string, evidence_fields array<string>, members array<string>"


def load_yaml(path: str, kind: str) -> dict:
    """A versioned file; a missing one is empty, another version is an error."""
    if not os.path.exists(path):
        return {"schema_version": VERSIONS[kind]}
    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    if data.get("schema_version") != VERSIONS[kind]:
        raise ValueError(f"{path}: schema version {data.get('schema_version')}, expected {VERSIONS[kind]}")
    return data


def table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Rows with the schema's fields; others are left out, missing ones are null."""
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    return spark.createDataFrame([tuple(r.get(f.name) for f in kind.fields) for r in rows], kind)


def pins_table(spark: SparkSession, overrides: dict) -> DataFrame:
    """Flattened pins: one row for each key and field."""
    rows = []
    for key, fields in (overrides.get("pins") or {}).items():
        for name, v in fields.items():
            if name == "suppress":
                rows.append({"key": key, "field": name, "variant": "suppress"})
            elif name == "suppress_children":
                rows.append({"key": key, "field": name, "variant": "suppress_children", "children": [str(x) for x in (v.get("suppress_children", v) if isinstance(v, dict) else v)]})
            elif name == "surface":
                rows.append({"key": key, "field": name, "variant": "value", "value": _as_json(v.get("value") if isinstance(v, dict) else v)})
            else:
                rows.append({"key": key, "field": name, "variant": "value", "value": str(v.get("value") if isinstance(v, dict) else v)})
    return table(spark, rows, PIN)


def _as_json(text: object) -> str:
    """A record written as YAML, as JSON; text that can't be read stays as it is."""
    try:
        return json.dumps(yaml.safe_load(text) if isinstance(text, str) else text, ensure_ascii=False, default=str)
    except yaml.YAMLError:
        return str(text)


def write_yaml(path: str, data: dict) -> None:
    """The file appears whole or not at all."""
    own = f"{path}.{uuid.uuid4().hex}"
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(own, "w", encoding="utf-8") as f:
        yaml.safe_dump(data, f, sort_keys=False, allow_unicode=True)
    os.replace(own, path)


def rows_of(df: DataFrame, order: str) -> list[dict]:
    """A projection's rows for a sink: sorted, without nulls."""
    clean = lambda v: [clean(x) for x in v] if isinstance(v, list) else {k: clean(x) for k, x in v.items() if x is not None} if isinstance(v, dict) else v
    return [clean(r.asDict(recursive=True)) for r in df.orderBy(order).collect()]


def load_cache(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """A response cache file; missing, malformed or of another version it is empty, and bad entries are left out."""
    from ..respond.cache import KEY, SCHEMA
    from ..respond.core import canonical_json

    rows = []
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        if data.get("version") == version:
            for e in data.get("entries", []):
                if isinstance(e, dict) and all(isinstance(e.get(k), str) for k in KEY[:5]) and "inputs" in e and "response" in e:
                    rows.append((*[e[k] for k in KEY[:5]], canonical_json(e["inputs"]), canonical_json(e["response"])))
    except (OSError, ValueError, AttributeError):
        pass
    return spark.createDataFrame(rows, SCHEMA)


def save_cache(cache: DataFrame, path: str, version: int = 1) -> None:
    entries = []
    for r in cache.orderBy("prompt", "model_id", "inputs").collect():
        e = r.asDict()
        entries.append(e | {"inputs": json.loads(e["inputs"]), "response": json.loads(e["response"])})
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "w", encoding="utf-8") as f:
        json.dump({"version": version, "entries": entries}, f, ensure_ascii=False)
    os.replace(own, path)


def agent_results(lines: DataFrame) -> DataFrame:
    """``(stream, line_no, is_error, result)``: the last ``result`` event of each stream; lines that aren't JSON are skipped.

    ``lines``: ``stream, line_no, line``.
    """
    kind = F.get_json_object("line", "$.type")
    ends = lines.where(kind == "result")
    last = ends.groupBy("stream").agg(F.max_by(F.struct("line_no", "line"), "line_no").alias("e"))
    g = lambda k: F.get_json_object("e.line", f"$.{k}")
    return last.select("stream", "e.line_no", F.coalesce(g("is_error").cast("boolean"), F.lit(False)).alias("is_error"), g("result").alias("result"))


def turn_messages(lines: DataFrame) -> DataFrame:
    """``(stream, failed, message)``: the last completed agent message of each stream, or the failure of its turn."""
    g = lambda k: F.get_json_object("line", f"$.{k}")
    said = (g("type") == "item.completed") & (g("item.type") == "agent_message")
    bad = g("type") == "turn.failed"
    agg = lines.groupBy("stream").agg(F.max_by(F.when(said, g("item.text")), F.when(said, F.col("line_no"))).alias("text"), F.max_by(F.when(bad, g("error.message")), F.when(bad, F.col("line_no"))).alias("why"), F.coalesce(F.max(bad), F.lit(False)).alias("failed"))
    return agg.select("stream", "failed", F.when(F.col("failed"), F.col("why")).otherwise(F.col("text")).alias("message"))


def tool_events(lines: DataFrame) -> DataFrame:
    """``(stream, line_no, event, name, ok)`` of tool uses and their results; a result without a mark went well."""
    blocks = F.from_json(F.get_json_object("line", "$.message.content"), "array<string>")
    b = lines.select("stream", "line_no", F.explode(blocks).alias("b"))
    g = lambda k: F.get_json_object("b", f"$.{k}")
    return b.where(g("type").isin("tool_use", "tool_result")).select("stream", "line_no", g("type").alias("event"), g("name").alias("name"), F.when(g("type") == "tool_result", ~F.coalesce(g("is_error").cast("boolean"), F.lit(False))).alias("ok"))


def interpolate(text: str, env: dict[str, str] | None = None) -> str:
    """``${NAME}`` from the environment, outside comments; an unset name is an error."""
    env = os.environ if env is None else env

    def line(s: str) -> str:
        quote, at = "", len(s)
        for i, c in enumerate(s):
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c == "#" and (i == 0 or s[i - 1].isspace()):
                at = i
                break

        def put(m):
            if m[1] not in env:
                raise KeyError(f"environment variable {m[1]} is not set")
            return env[m[1]]

        return re.sub(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}", put, s[:at]) + s[at:]

    return "\n".join(line(s) for s in text.split("\n"))


def utc_now(now: datetime | None = None) -> str:
    return max(now or datetime.now(UTC), datetime(1970, 1, 1, tzinfo=UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")


def scaffold(folder: str, templates: dict[str, str]) -> list[str]:
    """Write template files that aren't there yet; their names."""
    made = []
    os.makedirs(folder, exist_ok=True)
    for name, body in templates.items():
        p = os.path.join(folder, name)
        if not os.path.exists(p):
            with open(p, "w", encoding="utf-8") as f:
                f.write(body)
            made.append(name)
    return made
