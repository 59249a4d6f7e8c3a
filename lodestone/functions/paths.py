"""Path and identifier functions over columns. Paths are strings with forward slashes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def parent(p: Column) -> Column:
    """Path of the directory that holds ``p``; empty at the top."""
    return F.regexp_replace(p, "/?[^/]*$", "")


def depth(p: Column) -> Column:
    """Number of components."""
    return F.when(p == "", 0).otherwise(F.size(F.split(p, "/")))


def ancestors(p: Column, itself: bool = False) -> Column:
    """All directories above ``p``, the nearest last, without the empty root; with ``itself``, ``p`` too.

    Exploding this turns "lies under" into an equality, so a prefix join becomes a hash join.
    """
    parts = F.split(p, "/")
    n = F.size(parts) if itself else F.size(parts) - 1
    built = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return F.filter(F.when(n >= 1, built).otherwise(F.array().cast("array<string>")), lambda x: x != "")


def is_inside(p: Column, d: Column | str) -> Column:
    """Component-wise prefix; the empty directory holds everything."""
    d = F.lit(d) if isinstance(d, str) else d
    return (d == "") | (p == d) | F.startswith(p, F.concat(d, F.lit("/")))


def relative_to(p: Column, root: str) -> Column:
    """``p`` without ``root``; unchanged where it lies elsewhere."""
    return F.when(p == root, F.lit("")).when(F.startswith(p, F.lit(root + "/")), F.substr(p, F.lit(len(root) + 2))).otherwise(p)


def absolute(p: Column, root: str) -> Column:
    return F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), p))


def slug(s: Column) -> Column:
    """Lower-case ASCII letters and digits, everything else squeezed to single dashes; null when nothing is left.

    Lower-casing is spelt out for ASCII: the general function turns some other letters into ASCII ones.
    """
    low = F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.nullif(F.trim(F.regexp_replace(low, "[^a-z0-9]+", "-"), F.lit("-")), F.lit(""))


def leaf_slug(p: Column) -> Column:
    return F.coalesce(slug(basename(p)), F.lit("root"))


def slug_path(p: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(p, "/"), slug), lambda x: x.isNotNull()), "/")


def short_hash(p: Column) -> Column:
    """Eight hexadecimal digits of the path's SHA-256."""
    return F.substring(F.sha2(p, 256), 1, 8)


def glob_regex(glob: str, crosses_slash: bool = True) -> str:
    """Anchored regular expression of a glob with ``*``, ``**``, ``?``, ``[..]`` and ``{a,b}``.

    With ``crosses_slash``, ``*`` and ``?`` match slashes too.
    """
    any_, one = (".*", ".") if crosses_slash else ("[^/]*", "[^/]")
    out, i, braces = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += any_
        elif c == "?":
            out += one
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError(f"unclosed class in glob {glob!r}")
            inner = glob[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[:1] == "!" else inner).replace("\\", "\\\\") + "]"
            i = end
        elif c == "{":
            out, braces = out + "(?:", braces + 1
        elif c == "}" and braces:
            out, braces = out + ")", braces - 1
        elif c == "," and braces:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    if braces:
        raise ValueError(f"unclosed alternatives in glob {glob!r}")
    return f"^{out}$"


def matches_glob(p: Column, glob: str, crosses_slash: bool = True) -> Column:
    return p.rlike(glob_regex(glob, crosses_slash))


def is_glob(member: Column) -> Column:
    return F.contains(member, F.lit("/")) | F.contains(member, F.lit("*"))


def is_safe_relative(p: Column) -> Column:
    """A path that stays within its root by its letters: not absolute and without ``..``."""
    return ~F.startswith(p, F.lit("/")) & ~F.array_contains(F.split(p, "/"), "..")
