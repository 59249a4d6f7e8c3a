"""Reading tools for a model, kept within one directory and one budget of bytes."""

from __future__ import annotations

import os
import re
from typing import Protocol

from ..functions.paths import glob_regex
from ..sources.files import walk


class Escape(PermissionError):
    """A path that leads out of the root: absolute, with ``..``, or through a link."""


class FileTools(Protocol):
    def read_file(self, path: str, max_bytes: int | None = None) -> dict: ...

    def glob(self, pattern: str) -> dict: ...

    def grep(self, pattern: str, paths: list[str], max_matches: int | None = None) -> dict: ...

    def list_dir(self, path: str) -> dict: ...


def resolve(root: str, rel: str) -> str:
    """The real path of ``rel`` below ``root``, whether or not it exists; an ``Escape`` where it leads out."""
    if os.path.isabs(rel):
        raise Escape(f"absolute path: {rel}")
    if ".." in re.split(r"[/\\]" if os.sep == "\\" else "/", rel):
        raise Escape(f"path with ..: {rel}")
    base = os.path.realpath(root)
    # links anywhere on the way are followed, also to what doesn't exist
    real = os.path.realpath(os.path.join(base, rel))
    if real != base and os.path.commonpath([base, real]) != base:
        raise Escape(f"a link leads out: {rel}")
    return real


class SandboxedFiles:
    """Tools on the files below ``root``. All reads together give at most ``budget`` bytes, each at most ``cap``."""

    def __init__(self, root: str, budget: int = 1 << 20, cap: int = 64 << 10, most_paths: int = 1000, most_matches: int = 100):
        self.root, self.budget, self.cap, self.most_paths, self.most_matches = os.path.realpath(root), budget, cap, most_paths, most_matches
        self.bytes_read = 0

    def read_file(self, path: str, max_bytes: int | None = None) -> dict:
        real = resolve(self.root, path)
        size = os.path.getsize(real)
        grant = max(0, min(size, self.cap if max_bytes is None else min(self.cap, max_bytes), self.budget - self.bytes_read))
        with open(real, "rb") as f:
            data = f.read(grant)
        self.bytes_read += len(data)
        return {"content": data.decode("utf-8", "replace"), "bytes": len(data), "truncated": len(data) < size}

    def _inside(self) -> list[str]:
        out = []
        for p in walk(self.root):
            try:
                if os.path.isfile(resolve(self.root, p.rstrip("/"))):
                    out.append(p)
            except Escape:  # a link out of the root isn't part of it
                continue
        return out

    def glob(self, pattern: str) -> dict:
        if os.path.isabs(pattern) or ".." in pattern.split("/"):
            raise Escape(f"pattern leads out: {pattern}")
        rx = re.compile(glob_regex(pattern, crosses_slash=False))
        found = sorted(p for p in self._inside() if rx.match(p))
        return {"paths": found[: self.most_paths], "truncated": len(found) > self.most_paths}

    def grep(self, pattern: str, paths: list[str], max_matches: int | None = None) -> dict:
        rx, most = re.compile(pattern), min(self.most_matches, self.most_matches if max_matches is None else max_matches)
        bases = [os.path.relpath(resolve(self.root, p), self.root) for p in paths] or ["."]
        out = []
        for p in sorted(self._inside()):
            if not any(b == "." or p == b or p.startswith(b + "/") for b in bases):
                continue
            with open(resolve(self.root, p), encoding="utf-8", errors="replace") as f:
                for k, line in enumerate(f, 1):
                    if rx.search(line := line.rstrip("\r\n")):
                        if len(out) == most:
                            return {"matches": out, "truncated": True}
                        out.append({"path": p, "line": k, "text": line})
        return {"matches": out, "truncated": False}

    def list_dir(self, path: str) -> dict:
        real = resolve(self.root, path)
        kind = lambda e: "link" if e.is_symlink() else "dir" if e.is_dir() else "file"
        return {"entries": sorted(({"name": e.name, "kind": kind(e)} for e in os.scandir(real)), key=lambda e: e["name"])}
