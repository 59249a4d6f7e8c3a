"""Model calls in parallel, in executors, under one token budget.

The driver keeps the count. Each round it deals the requests that are left to tasks and leases each task an equal part of the
tokens that are left; a task pays its answers from its lease and stops at the first one that the lease doesn't cover. What
tasks didn't use goes back into the next round, which has fewer tasks with larger leases if answers turned out dear. A round
is written as a table, so that a task's payments count once, when it commits, however often the task is tried.

An answer is kept in a journal, one object for each key, as soon as it is there and before it is paid for. A task that is
tried again, and a later round, find it there and don't ask twice; neither does another run that names the same folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.settle import discard, forget_folder, settle, shared_folder
from .core import Budget, Responder, SetupError, canonical_json, estimate

#: Tasks of a round for each slot, so that slow answers don't leave slots idle.
TASKS_A_SLOT = 4
#: What became of a request: paid for, answered beyond the lease, not asked, failed, failed as all others would.
PAID, UNPAID, LEFT, FAILED, NO_SETUP = "paid", "unpaid", "left", "failed", "setup"


class Journal:
    """One object for each answered key, in a folder that all machines reach: ``file:`` where mounted, or a store that pyarrow knows."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, self.base = fs.FileSystem.from_uri(folder)
        self.made: set[str] = set()

    def _place(self, key: str) -> str:
        return f"{self.base}/{key[:2]}/{key}"

    def get(self, key: str) -> dict | None:
        from pyarrow.fs import FileType

        if self.fs.get_file_info(self._place(key)).type != FileType.File:
            return None
        with self.fs.open_input_stream(self._place(key)) as f:
            return json.loads(f.read())

    def put(self, key: str, entry: dict) -> None:
        if key[:2] not in self.made:
            self.fs.create_dir(f"{self.base}/{key[:2]}", recursive=True)
            self.made.add(key[:2])
        draft = f"{self._place(key)}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps(entry, ensure_ascii=False).encode())
        self.fs.move(draft, self._place(key))


def work(rows: Iterable[tuple[str, str, str]], responder: Responder, journal: Journal, lease: int | None) -> Iterator[tuple]:
    """``(response, error, cost, state)`` of each request ``(key, prompt, inputs)`` of a task, in order."""
    over: tuple[str | None, str] | None = None
    for key, prompt, inputs in rows:
        if over is not None:
            yield None, over[0], None, over[1]
            continue
        entry = journal.get(key)
        if entry is None:
            try:
                answer = canonical_json(responder.call(prompt, json.loads(inputs)))
                entry = {"response": answer, "error": None, "cost": estimate(inputs, answer)}
            except SetupError as e:
                over = f"SetupError: {e}", NO_SETUP
                yield None, over[0], None, NO_SETUP
                continue
            except Exception as e:  # one failed answer doesn't stop the others
                entry = {"response": None, "error": f"{type(e).__name__}: {e}", "cost": 0}
            journal.put(key, entry)
        if entry["error"] is not None:
            yield None, entry["error"], 0, FAILED
        elif lease is not None and entry["cost"] > lease:
            over = None, LEFT
            yield None, None, entry["cost"], UNPAID
        else:
            lease = None if lease is None else lease - entry["cost"]
            yield entry["response"], None, entry["cost"], PAID


def answer_leased(missing: DataFrame, keys: tuple[str, ...], responder: Responder, budget: Budget, folder: str | None = None, parallel: int | None = None, persist: Callable[[DataFrame], None] | None = None, told: Callable[[str, str, bool], None] | None = None) -> DataFrame:
    """``keys, response, error`` for each row of ``missing`` (``keys`` with ``prompt`` and ``inputs`` among them, each key once).

    At most ``parallel`` calls run at a time, by default as many as the session has slots. No payment goes over the budget: when
    a single task with all that is left can't pay its cheapest answer, the requests left fail with ``BudgetExceeded``.
    Answers that weren't paid for are lost, at most one for each task of a round. A setup failure stops its task and, after the
    round, all requests. ``persist`` gets each round's paid answers, ``told`` each settled request's prompt, inputs and
    whether it was answered. The journal lies in ``folder``, which stays, or in a folder of this call's own.
    """
    spark = missing.sparkSession
    slots = parallel or spark.sparkContext.defaultParallelism
    own = folder is None
    folder = folder or f"{shared_folder(spark)}/lodestone/journal-{uuid.uuid4().hex}"
    hashed = F.sha2(F.to_json(F.array(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])), 256)
    left = settle(missing.select(*keys, hashed.alias("_key"), F.lit(None).cast("long").alias("cost")))
    done, dear, error = [], 1, None
    schema = ", ".join(f"{k} string" for k in (*keys, "_key", "response", "error")) + ", cost long, state string"
    while n := left.count():
        free = None if budget.limit is None else max(0, budget.limit - budget.used)
        tasks = min(n, slots * (1 if parallel else TASKS_A_SLOT))
        tasks = tasks if free is None else max(1, min(tasks, free // dear))
        lease = None if free is None else free // tasks

        def run(batches, lease=lease):
            journal = Journal(folder)
            parts: list[pd.DataFrame] = []

            def rows():
                for pdf in batches:
                    parts.append(pdf)
                    yield from zip(pdf["_key"], pdf["prompt"], pdf["inputs"], strict=True)

            # one worker for all of the task's batches, so that the lease is that of the task
            got, sent = [], 0
            for x in work(rows(), responder, journal, lease):
                got.append(x)
                if sum(map(len, parts[sent:])) == len(got):
                    pdf = pd.concat(parts[sent:])[[*keys, "_key"]]
                    yield pdf.assign(response=[g[0] for g in got], error=[g[1] for g in got], cost=pd.array([g[2] for g in got], dtype="Int64"), state=[g[3] for g in got])
                    got, sent = [], len(parts)

        dealt = left.repartition(tasks) if tasks > 1 else left.coalesce(1)
        # answers that are there already come first, the cheapest before others
        got = settle(dealt.sortWithinPartitions(F.col("cost").asc_nulls_last(), "_key").mapInPandas(run, schema))
        discard(left)
        seen = {r["state"]: r for r in got.groupBy("state").agg(F.count("*").alias("n"), F.sum("cost").alias("cost"), F.max("cost").alias("dear")).collect()}
        if PAID in seen:
            budget.used += seen[PAID]["cost"]
            if persist is not None:
                persist(got.where(F.col("state") == PAID).select(*keys, "response"))
        settled = got.where(F.col("state").isin(PAID, FAILED, NO_SETUP))
        done.append(settled.select(*keys, "response", "error"))
        if told is not None:
            for r in settled.select("prompt", "inputs", "state").toLocalIterator():
                told(r["prompt"], r["inputs"], r["state"] == PAID)
        dear = max(1, seen[UNPAID]["dear"]) if UNPAID in seen else dear
        left = settle(got.where(F.col("state").isin(UNPAID, LEFT)).select(*keys, "_key", "cost"))
        if NO_SETUP in seen:
            error = got.where(F.col("state") == NO_SETUP).first()["error"]
        elif tasks == 1 and PAID not in seen and FAILED not in seen:
            error = f"BudgetExceeded: {budget.used} of {budget.limit} tokens are used, {n} requests are left"
        if error is not None:
            done.append(left.select(*keys, F.lit(None).cast("string").alias("response"), F.lit(error).alias("error")))
            if told is not None:
                for r in left.select("prompt", "inputs").toLocalIterator():
                    told(r["prompt"], r["inputs"], False)
            break
    none = spark.createDataFrame([], ", ".join(f"{k} string" for k in (*keys, "response", "error")))
    out = none
    for d in done:
        out = out.union(d)
    if own:
        forget_folder(folder)
    return out
