"""Prompt templates: ``{{NAME}}`` is replaced, ``{{{{`` and ``}}}}`` stand for literal braces."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARK = re.compile(r"\{\{\{\{|\}\}\}\}|\{\{|\}\}")
BOUNDARY = "<!-- cache-boundary -->"


def names(template: str) -> list[str]:
    """Names in order of appearance, each once."""
    out: list[str] = []
    _walk(template, lambda n: out.append(n) or "")
    return list(dict.fromkeys(out))


def render(template: str, values: dict[str, object]) -> str:
    """Strings go in as they are, other values as JSON. An unknown name or an unclosed one is an error."""

    def fill(name: str) -> str:
        if name not in values:
            raise KeyError(f"template asks for unknown {name}")
        v = values[name]
        return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)

    return _walk(template, fill)


def filled(template: str, values: dict[str, Column]) -> Column:
    """``render`` of one template for every row: columns of text as they are, others in their text form. The template is read once, here."""
    parts: list[Column] = []
    mark = "\0"

    def fill(name: str) -> str:
        if name not in values:
            raise KeyError(f"template asks for unknown {name}")
        parts.append(values[name].cast("string"))
        return mark

    texts = _walk(template.replace(mark, ""), fill).split(mark)
    return F.concat(F.lit(texts[0]), *[c for part, text in zip(parts, texts[1:], strict=True) for c in (part, F.lit(text))])


def gaps(template: Column, keys: Column, unseen: Column) -> tuple[Column, Column]:
    """``coverage`` by columns: sorted arrays of names without a key, and of keys, other than ``unseen`` ones, without a name."""
    bare = F.regexp_replace(template, r"\{\{\{\{|\}\}\}\}", "")
    found = F.array_distinct(F.transform(F.regexp_extract_all(bare, F.lit(r"\{\{(.*?)\}\}"), F.lit(1)), lambda x: F.trim(x)))
    return F.array_sort(F.array_except(found, keys)), F.array_sort(F.array_except(F.array_except(keys, found), unseen))


def object_problems(value: Column, required: tuple[str, ...]) -> Column:
    """``problems`` of JSON text against a schema that asks for an object with these keys, joined by commas."""
    keys = F.json_object_keys(value)
    missing = [F.when(~F.array_contains(keys, k), f"missing {k}") for k in required]
    return F.when(keys.isNull(), "expected object").otherwise(F.concat_ws(",", *missing))


def _walk(template: str, fill) -> str:
    out, at = [], 0
    while m := _MARK.search(template, at):
        out.append(template[at : m.start()])
        at = m.end()
        if m[0] == "{{{{":
            out.append("{{")
        elif m[0] == "}}}}":
            out.append("}}")
        elif m[0] == "{{":
            end = template.find("}}", at)
            if end < 0:
                raise ValueError("unclosed name in template")
            out.append(fill(template[at:end].strip()))
            at = end + 2
        else:
            out.append("}}")
    return "".join([*out, template[at:]])


def split_at_boundary(prompt: str) -> tuple[str, str]:
    """The part that stays the same between calls, and the rest; without a boundary all is rest."""
    head, mark, tail = prompt.partition(BOUNDARY)
    return (head, tail) if mark else ("", prompt)


def coverage(template: str, keys: set[str], unseen: set[str] = frozenset()) -> tuple[set[str], set[str]]:
    """Names without a key, and keys (other than ``unseen`` ones, which serve the cache) without a name."""
    found = set(names(template))
    return found - keys, keys - found - set(unseen)


def problems(value: object, schema: dict) -> list[str]:
    """Checks ``type`` and ``required`` of a JSON schema."""
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
    kind = schema.get("type")
    ok = isinstance(value, kinds[kind]) if kind in kinds else isinstance(value, (int, float)) and not isinstance(value, bool) if kind in ("number", "integer") else True
    if not ok:
        return [f"expected {kind}"]
    return [f"missing {k}" for k in schema.get("required", ()) if isinstance(value, dict) and k not in value]


def request_body(prompt: str) -> list[dict]:
    """Message blocks: what precedes the boundary is marked to be kept by the provider."""
    head, tail = split_at_boundary(prompt)
    out = [{"type": "text", "text": head, "cache_control": {"type": "ephemeral"}}] if head else []
    return [*out, {"type": "text", "text": tail}]
