"""Manifest shapes and dependencies."""

from __future__ import annotations

import tomllib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_KEYS = ("dependencies", "dev-dependencies", "build-dependencies")


def _toml(text) -> dict | None:
    try:
        return tomllib.loads(text) if text is not None else None
    except tomllib.TOMLDecodeError:
        return None


def cargo_shape(text: Column | str) -> Column:
    """Which sections a crate manifest has (``has_lib, has_bin, has_workspace``); malformed text has none."""
    return F.pandas_udf(_cargo_shape, "has_lib boolean, has_bin boolean, has_workspace boolean")(text)


def cargo_dependencies(text: Column | str) -> Column:
    """External crates, ``(seq, id, purl)``, in the order of their sections; those given by a path are left out."""
    return F.pandas_udf(_cargo_dependencies, "array<struct<seq:int,id:string,purl:string>>")(text)


def _cargo_shape(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        d = _toml(t) or {}
        rows.append((isinstance(d.get("lib"), dict), isinstance(d.get("bin"), list), isinstance(d.get("workspace"), dict)))
    return pd.DataFrame(rows, columns=["has_lib", "has_bin", "has_workspace"])


def _cargo_dependencies(texts: pd.Series) -> pd.Series:
    def one(t):
        d, out = _toml(t) or {}, []
        for key in _KEYS:
            table = d.get(key)
            for name, spec in sorted(table.items()) if isinstance(table, dict) else ():
                if isinstance(spec, dict) and "path" in spec:
                    continue
                version = spec if isinstance(spec, str) else spec.get("version") if isinstance(spec, dict) else None
                purl = f"pkg:cargo/{name}@{version}" if isinstance(version, str) else None
                out.append({"seq": len(out), "id": f"crate:{name}", "purl": purl})
        return out

    return texts.map(one)


def package_shape(text: Column) -> Column:
    """``main``, ``exports`` and ``bin`` of a package manifest, by presence of the key; malformed text has none."""
    keys = F.json_object_keys(text)
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False)).alias(f"has_{k}")
    return F.struct(has("main"), has("exports"), has("bin"))


def package_dependencies(text: Column) -> Column:
    """``(id, purl)`` for each dependency; a purl only where the version is a string."""
    parts = []
    for key in ("dependencies", "devDependencies", "peerDependencies"):
        raw = F.get_json_object(text, f"$.{key}")
        table = F.map_entries(F.from_json(raw, "map<string,string>"))
        parts.append(F.coalesce(table, F.array().cast("array<struct<key:string,value:string>>")))
    every = F.concat(*parts)
    return F.transform(every, lambda e: F.struct(F.concat(F.lit("npm:"), e["key"]).alias("id"), F.when(~e["value"].rlike(r"^[\[{]"), F.concat(F.lit("pkg:npm/"), e["key"], F.lit("@"), e["value"])).alias("purl")))
