"""The response cache as a table, and answering what it lacks."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.settle import settle
from .core import Budget, Responder, canonical_json
from .leases import answer_leased

KEY = ("template_sha", "ontology_sha", "model_id", "backend_version", "prompt", "inputs")
SCHEMA = ", ".join(f"{k} string" for k in (*KEY, "response"))


def keyed(requests: DataFrame, responder: Responder) -> DataFrame:
    """``requests(prompt, inputs)`` (inputs as key-sorted JSON) with the responder's fingerprint, each key once."""
    cols = [F.lit(v).alias(k) for k, v in zip(KEY[:4], responder.fingerprint().columns(), strict=True)]
    return requests.select(*cols, "prompt", "inputs").dropDuplicates(list(KEY))


def hits(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache, list(KEY))


def misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    return requests.join(cache, list(KEY), "left_anti")


def answer_all(missing: DataFrame, responder: Responder) -> DataFrame:
    """Call the responder for each row, in parallel; a failed call gives a null response and its error.

    Keys come once, so no key is asked for twice unless a task is repeated; the result goes to a
    table before it is used.
    """

    def run(batches):
        for pdf in batches:
            got, errors = [], []
            for prompt, inputs in zip(pdf["prompt"], pdf["inputs"], strict=True):
                try:
                    got.append(canonical_json(responder.call(prompt, json.loads(inputs))))
                    errors.append(None)
                except Exception as e:  # one failed answer doesn't stop the others
                    got.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(response=got, error=errors)

    return missing.mapInPandas(run, SCHEMA + ", error string")


def answer_within(missing: DataFrame, responder: Responder, budget: Budget, **options) -> DataFrame:
    """Call the responder in executors under a token budget; options are those of ``answer_leased``."""
    return answer_leased(missing, KEY, responder, budget, **options)


class ResponseCache:
    """A table of answers by key, with counters of what had to be asked.

    ``calls`` counts the answers that a responder gave, ``errors`` the requests that failed; both
    since the beginning or the last ``clear``. ``settle`` writes a table, so that the cache's plan doesn't grow and answers
    that a plan would ask for are asked for once.
    """

    def __init__(self, entries: DataFrame, settle: Callable[[DataFrame], DataFrame] = settle):
        self.entries, self.settle = entries.select(*KEY, "response"), settle
        self.calls = self.errors = 0

    def missing(self, asked: DataFrame) -> DataFrame:
        return misses(asked, self.entries)

    def found(self, asked: DataFrame) -> DataFrame:
        return hits(asked, self.entries)

    def record(self, answers: DataFrame) -> int:
        """Take in ``answers`` (keys, ``response``, ``error``) and count them; the number of failed ones."""
        answers = self.settle(answers)
        n = answers.agg(F.count("response").alias("ok"), F.count_if(F.col("response").isNull()).alias("bad")).first()
        self.calls += n["ok"]
        self.errors += n["bad"]
        if n["ok"]:
            self.seed(answers.where("response is not null"))
        return n["bad"]

    def seed(self, entries: DataFrame) -> None:
        """Put in answers without a call; a key that is there already gets the new answer."""
        new = entries.select(*KEY, "response").dropDuplicates(list(KEY))
        self.entries = self.settle(misses(self.entries, new).union(new))

    def clear(self) -> None:
        self.entries = self.entries.where("1 = 0")
        self.calls = self.errors = 0

    def snapshot(self) -> DataFrame:
        """All entries, in key order."""
        return self.entries.orderBy(*KEY)


def placed(entries: DataFrame) -> DataFrame:
    """Entries of one fingerprint with their ``place`` in the order of keys, from 1.

    Prompts are few, so each prompt's entries are ranked by themselves and what stands before the prompt is added.
    """
    own = F.row_number().over(Window.partitionBy("prompt").orderBy("inputs"))
    sizes = entries.groupBy("prompt").agg(F.count("*").alias("_n"))
    first = sizes.select("prompt", (F.sum("_n").over(Window.orderBy("prompt").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_first"))
    return entries.withColumn("_own", own).join(first, "prompt").withColumn("place", (F.col("_own") + F.col("_first")).cast("long")).drop("_own", "_first")


def running_cost(requests: DataFrame) -> DataFrame:
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return requests.withColumn("running", F.sum("cost").over(w))


def breakdown(requests: DataFrame) -> DataFrame:
    return requests.groupBy("prompt").agg(F.count("*").alias("calls"))
