"""Text functions over columns: file recognition, headings, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .paths import basename


def is_manifest(p: Column) -> Column:
    b = basename(p)
    return b.isin(*vocab.MANIFESTS) | F.endswith(b, F.lit(vocab.MANIFEST_SUFFIX))


def is_readme(p: Column) -> Column:
    """By the name before its first dot, in ASCII capitals."""
    stem = F.substring_index(basename(p), ".", 1)
    return F.translate(stem, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").isin(*vocab.README_STEMS)


def heading_level(line: Column) -> Column:
    """1 to 6 for a heading in the number-sign style, null otherwise."""
    return F.when(heading_text(line).isNotNull(), F.length(F.regexp_extract(line, r"^(#{1,6}) ", 1)))


def heading_text(line: Column) -> Column:
    """Text of a heading: one to six signs at the first column, one space, then text without closing signs."""
    body = F.regexp_extract(line, r"^#{1,6} (.*)$", 1)
    bare = F.rtrim(F.regexp_replace(_trim_end(body), "#+$", ""))
    return F.when(line.rlike(r"^#{1,6} "), F.nullif(_trim_end(bare), F.lit("")))


def _trim_end(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+$", "")


def is_fence(line: Column) -> Column:
    return F.trim(line).rlike(r"^(```|~~~)")


def shebang(text: Column) -> Column:
    """Interpreter line of a script, trimmed; null without one."""
    return F.when(F.startswith(text, F.lit("#!")), F.trim(F.regexp_extract(text, r"^#!([^\r\n]*)", 1)))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def flatten(c: Column) -> Column:
    """A paragraph on one line."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fixed(x: Column, places: int) -> Column:
    """A double from 1 on with so many digits (one to three) after its point, rounded by its exact binary value, ties to even, as C and Rust do.

    ``format_string`` and ``round`` round the shortest decimal that stands for the double, half up.
    """
    # what follows the point is a multiple of 2**-52, so that whole numbers hold it
    part = ((x - F.floor(x)) * float(1 << 52)).cast("long") * 10**places
    digits, rest, half = F.shiftright(part, 52), part.bitwiseAND((1 << 52) - 1), 1 << 51
    up = (rest > half) | (rest == half) & (digits % 2 == 1)
    digits = digits + F.when(up, 1).otherwise(0)
    return F.concat((F.floor(x) + F.when(digits == 10**places, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad((digits % 10**places).cast("string"), places, "0"))


def abbreviate(n: Column) -> Column:
    """9999, 12.3k, 1.23M; null for null."""
    return F.when(n < 10_000, n.cast("string")).when(n < 1_000_000, F.concat(fixed(n / 1000.0, 1), F.lit("k"))).otherwise(F.concat(fixed(n / 1_000_000.0, 2), F.lit("M")))


def minutes_seconds(seconds: Column) -> Column:
    """Whole minutes and the seconds left, both towards zero; null for null."""
    return F.when(seconds.isNotNull(), F.format_string("%02d:%02d", F.call_function("div", seconds, F.lit(60)), seconds % 60))


def rfc3339(ts: Column) -> Column:
    """UTC, whole seconds, nothing before 1970."""
    return F.date_format(F.greatest(ts, F.lit("1970-01-01 00:00:00").cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def clip(c: Column, width: int) -> Column:
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 1), F.lit("…"))).otherwise(c)


def strip_fence(c: Column) -> Column:
    """Content of a fenced block, or the trimmed text."""
    inner = F.regexp_extract(F.trim(c), r"(?s)^```[A-Za-z]*\s*\n?(.*?)\n?```$", 1)
    return F.when(F.trim(c).rlike(r"(?s)^```.*```$"), F.trim(inner)).otherwise(F.trim(c))


def token_estimate(*parts: Column) -> Column:
    """A quarter of the bytes."""
    total = F.lit(0)
    for p in parts:
        total = total + F.octet_length(F.coalesce(p, F.lit("")))
    return F.floor(total / 4).cast("long")


def bullets(items: Column) -> Column:
    return F.concat_ws("\n", F.transform(items, lambda x: F.concat(F.lit("- "), x)))


def kind_suggestion(kind: Column) -> Column:
    pairs = [F.lit(x) for kv in vocab.KIND_SUGGESTIONS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), kind)


def provider_of(model_id: Column) -> Column:
    """What stands before the first slash of ``provider/model``; null without one."""
    return F.when(F.contains(model_id, F.lit("/")), F.substring_index(model_id, "/", 1))


def model_of(model_id: Column) -> Column:
    return F.regexp_replace(model_id, "^[^/]*/", "")


# Which field of a tool's input says what it works on.
TOOL_FIELDS = {"Read": "file_path", "Edit": "file_path", "Write": "file_path", "Grep": "pattern", "Glob": "pattern", "Bash": "command", "Task": "subagent_type"}


def tool_summary(tool: Column, input_json: Column) -> Column:
    """What a tool call works on; empty for unknown tools and inputs that don't fit."""
    out = F.lit("")
    for name, field in TOOL_FIELDS.items():
        out = F.when(tool == name, F.coalesce(F.get_json_object(input_json, f"$.{field}"), F.lit(""))).otherwise(out)
    return out


# Fixed value: the wrapper of a login shell.
SHELL = "/bin/zsh -lc "


def shell_summary(command: Column) -> Column:
    """The command inside a login shell's wrapper, without its quotes."""
    inner = F.trim(F.regexp_extract(F.trim(command), f"(?s)^{SHELL}(.*)$", 1))
    bare = F.when(inner.rlike("""(?s)^".*"$|^'.*'$""") & (F.length(inner) > 1), F.regexp_replace(inner, """(?s)^["'](.*)["']$""", "$1")).otherwise(inner)
    return F.when(F.startswith(F.trim(command), F.lit(SHELL)), bare).otherwise(F.trim(command))


def provider_text(body: Column) -> Column:
    """The answer in a provider's response body, of either common form, without a code fence."""
    return strip_fence(F.coalesce(F.get_json_object(body, "$.content[0].text"), F.get_json_object(body, "$.choices[0].message.content")))


def status_line(name: Column, summary: Column, failed: Column, width: int) -> Column:
    """One line about an agent's step, cut to a width, with a mark for a failure."""
    return F.concat(F.when(failed, F.lit("✗ ")).otherwise(F.lit("")), name, F.when(summary == "", F.lit("")).otherwise(F.concat(F.lit(" "), clip(summary, width))))


def prompt_head(prompt: Column, boundary: str) -> Column:
    """What precedes the boundary and stays the same between calls; empty without one."""
    at = F.instr(prompt, F.lit(boundary))
    return F.when(at > 0, F.substring(prompt, F.lit(1), at - 1)).otherwise("")


def prompt_tail(prompt: Column, boundary: str) -> Column:
    """What follows the boundary; everything without one."""
    at = F.instr(prompt, F.lit(boundary))
    return F.when(at > 0, F.substring(prompt, at + len(boundary), F.length(prompt))).otherwise(prompt)


def prompt_block_count(prompt: Column, boundary: str) -> Column:
    """Blocks that a request is sent in: an empty head makes none."""
    return F.when(prompt_head(prompt, boundary) != "", 2).otherwise(1)


def template_digest(*named: tuple[Column, Column]) -> Column:
    """Digest of templates, given as names and bodies in order."""
    return F.sha2(F.concat(*[F.concat(name, F.lit("\0"), body) for name, body in named]), 256)
