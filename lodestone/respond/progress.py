"""What a run tells whoever watches it. Events are made on the driver, in order."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol, TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Started:
    root: str


@dataclass(frozen=True)
class Phase:
    """``seed``, ``fixedpoint``, ``project`` or ``edges`` begins."""

    name: str


@dataclass(frozen=True)
class RoundStarted:
    number: int
    components: int


@dataclass(frozen=True)
class Carving:
    """Component ``k`` of ``n`` that this round proposes to carve."""

    component: str
    path: str
    k: int
    n: int


@dataclass(frozen=True)
class RoundEnded:
    number: int
    added: int
    seconds: float


@dataclass(frozen=True)
class Surface:
    """Component ``k`` of ``n`` has been described."""

    component: str
    path: str
    k: int
    n: int


@dataclass(frozen=True)
class Finished:
    components: int
    calls: int
    tokens_used: int
    token_budget: int | None
    seconds: float
    by_prompt: dict = field(default_factory=dict)


Event = Started | Phase | RoundStarted | Carving | RoundEnded | Surface | Finished


class Progress(Protocol):
    def on_event(self, event: Event) -> None: ...


class Silent:
    def on_event(self, event: Event) -> None:
        pass


class Recorder:
    """Keeps all events."""

    def __init__(self):
        self.events: list[Event] = []

    def on_event(self, event: Event) -> None:
        self.events.append(event)


class Narrator:
    """One line for each event."""

    def __init__(self, out: TextIO | None = None):
        self.out = out or sys.stderr

    def on_event(self, event: Event) -> None:
        print(told(event), file=self.out, flush=True)


def told(e: Event) -> str:
    match e:
        case Started(root):
            return f"analysing {root}"
        case Phase(name):
            return f"-- {name}"
        case RoundStarted(number, components):
            return f"round {number}: {components} components"
        case Carving(component, path, k, n):
            return f"  carving {k}/{n} {component} ({path})"
        case RoundEnded(number, added, seconds):
            return f"round {number}: {added} directories added in {clock(seconds)}"
        case Surface(component, path, k, n):
            return f"  described {k}/{n} {component} ({path})"
        case Finished():
            budget = f"/{e.token_budget}" if e.token_budget is not None else ""
            calls = ", ".join(f"{n} {p}" for p, n in sorted(e.by_prompt.items())) or "none"
            return f"done in {clock(e.seconds)}: {e.components} components, {e.calls} calls ({calls}), {e.tokens_used}{budget} tokens"
    raise TypeError(f"not an event: {e!r}")


def clock(seconds: float) -> str:
    return f"{int(seconds) // 60:02d}:{int(seconds) % 60:02d}"


class Rounds:
    """Hooks of a fixed-point loop over pairs ``(id, sub_dir)`` that tell when each round begins, what it carves and when it ends."""

    def __init__(self, progress: Progress, components: Callable[[], int]):
        self.progress, self.components, self.began = progress, components, 0.0

    def before(self, number: int) -> None:
        self.began = time.monotonic()
        self.progress.on_event(RoundStarted(number, self.components()))

    def after(self, number: int, new: DataFrame) -> None:
        """``new``: the pairs that this round added, as a written table."""
        n = new.select("id").distinct().count()
        for k, r in enumerate(new.groupBy("id").agg(F.min("sub_dir").alias("d")).orderBy("id").toLocalIterator(), 1):
            self.progress.on_event(Carving(r["id"], r["d"].rpartition("/")[0], k, n))
        self.progress.on_event(RoundEnded(number, new.count(), time.monotonic() - self.began))
