"""Requests to a model and who answers them.

A request is ``(prompt, inputs)``; with the responder's fingerprint it is the key under which its answer is
kept. There is no network here: ``Canned`` answers from a table, other responders implement ``Responder``.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol

#: The prompts of the pipeline.
PROMPTS = ("classify", "surface", "edges", "subcarve")


class BudgetExceeded(RuntimeError):
    """An answer would cost more tokens than are left; it is thrown away."""


class SetupError(RuntimeError):
    """No answer can be had at all, whatever the request."""


@dataclass(frozen=True)
class Fingerprint:
    template_sha: str
    ontology_sha: str
    model_id: str
    backend_version: str

    def columns(self) -> tuple[str, str, str, str]:
        return self.template_sha, self.ontology_sha, self.model_id, self.backend_version


class Responder(Protocol):
    def call(self, prompt: str, inputs: dict) -> object: ...

    def fingerprint(self) -> Fingerprint: ...


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def cache_key(fp: Fingerprint, prompt: str, inputs: object) -> str:
    return hashlib.sha256("\0".join((*fp.columns(), prompt, canonical_json(inputs))).encode()).hexdigest()


def template_sha(named: Iterable[tuple[str, str]]) -> str:
    h = hashlib.sha256()
    for name, body in named:
        h.update(name.encode() + b"\0" + body.encode())
    return h.hexdigest()


@dataclass
class Canned:
    """Answers from a table of ``(prompt, canonical inputs)``; a miss is an error."""

    answers: dict[tuple[str, str], object]
    fp: Fingerprint = Fingerprint("t", "o", "canned", "1")

    def call(self, prompt: str, inputs: dict) -> object:
        key = (prompt, canonical_json(inputs))
        if key not in self.answers:
            raise LookupError(f"no canned answer for {prompt}")
        return self.answers[key]

    def fingerprint(self) -> Fingerprint:
        return self.fp


@dataclass
class Budget:
    """Counts tokens; a charge that goes over leaves the count as it was, smaller ones may follow."""

    limit: int | None
    used: int = 0

    def charge(self, n: int) -> None:
        if self.limit is not None and self.used + n > self.limit:
            raise BudgetExceeded(f"{self.used} + {n} > {self.limit}")
        self.used += n


def estimate(prompt: str, answer: str) -> int:
    return (len(prompt.encode()) + len(answer.encode())) // 4


@dataclass
class Budgeted:
    """Charges after the call; an answer that the budget doesn't cover is lost."""

    inner: Responder
    budget: Budget
    cost: Callable[[str, str], int] = estimate

    def call(self, prompt: str, inputs: dict) -> object:
        out = self.inner.call(prompt, inputs)
        self.budget.charge(self.cost(canonical_json(inputs), canonical_json(out)))
        return out

    def fingerprint(self) -> Fingerprint:
        return self.inner.fingerprint()


@dataclass
class Sentinel:
    """Remembers the first budget or setup failure; from then on every call fails alike."""

    inner: Responder
    failure: Exception | None = None

    def call(self, prompt: str, inputs: dict) -> object:
        if self.failure is not None:
            raise type(self.failure)(str(self.failure))
        try:
            return self.inner.call(prompt, inputs)
        except (BudgetExceeded, SetupError) as e:
            self.failure = e
            raise

    def fingerprint(self) -> Fingerprint:
        return self.inner.fingerprint()


@dataclass
class Router:
    """Sends each prompt to its responder; the fingerprint names them all."""

    routes: dict[str, Responder]
    default: Responder
    #: prompts that need a responder which reads files, and responders that can't
    need_files: tuple[str, ...] = ("surface", "edges")
    fileless: tuple[Responder, ...] = ()

    def __post_init__(self):
        for p in self.need_files:
            if any(self.of(p) is r for r in self.fileless):
                raise ValueError(f"prompt {p} needs a responder that reads files")

    def of(self, prompt: str) -> Responder:
        return self.routes.get(prompt, self.default)

    def call(self, prompt: str, inputs: dict) -> object:
        return self.of(prompt).call(prompt, inputs)

    def fingerprint(self) -> Fingerprint:
        own = [self.of(p).fingerprint() for p in PROMPTS]
        join = lambda xs: "+".join(dict.fromkeys(xs))
        return Fingerprint(*[join(x) for x in zip(*[f.columns() for f in own], strict=True)])


@dataclass
class Observed:
    """Tells an observer about each call: started, then ended even if it fails."""

    inner: Responder
    observer: Callable[[str, dict], None]

    def call(self, prompt: str, inputs: dict) -> object:
        self.observer("started", {"prompt": prompt})
        ok = False
        try:
            out = self.inner.call(prompt, inputs)
            ok = True
            return out
        finally:
            self.observer("ended", {"prompt": prompt, "ok": ok})

    def fingerprint(self) -> Fingerprint:
        return self.inner.fingerprint()


@dataclass
class Config:
    """Settings of providers, checked on the driver."""

    default_model: str
    providers: dict[str, dict] = field(default_factory=dict)
    operations: dict[str, str] = field(default_factory=dict)

    def problems(self) -> list[str]:
        out = []
        for op in self.operations:
            if op not in PROMPTS:
                out.append(f"unknown operation {op}")
        for where, model in [("defaults", self.default_model), *self.operations.items()]:
            if "/" not in model:
                out.append(f"{where}: model id {model!r} names no provider")
                continue
            entry = self.providers.get(model.split("/", 1)[0])
            if entry is None:
                out.append(f"{where}: no entry for provider {model.split('/', 1)[0]}")
            elif entry.get("kind") == "http":
                if not entry.get("api_key"):
                    out.append(f"{where}: the provider needs an api_key")
                if not isinstance(entry.get("max_tokens"), int) or entry["max_tokens"] <= 0:
                    out.append(f"{where}: the provider needs a positive max_tokens")
        return list(dict.fromkeys(out))
