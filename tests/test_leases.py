"""Model calls in executors under one budget: leases, the journal, what is asked and paid for."""

import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from lodestone.respond import cache as C
from lodestone.respond import leases as L
from lodestone.respond.core import Budget, Fingerprint, SetupError, canonical_json, estimate


def responder(log, size=lambda n: 8, wait=0.0, fail=lambda n: None):
    """Notes each call, by process, in a folder. A local class travels to workers by value."""

    class Noting:
        def call(self, prompt, inputs):
            n = inputs["n"]
            began = time.time()
            time.sleep(wait)
            with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
                f.write(f"{n} {os.getpid()} {began} {time.time()}")
            if fail(n) is not None:
                raise fail(n)
            return "x" * size(n)

        def fingerprint(self):
            return Fingerprint("t", "o", "noting", "1")

    return Noting()


def calls(log):
    return [tuple(open(f"{log}/{x}").read().split()) for x in os.listdir(log)]


def asked(spark, r, n):
    return C.keyed(spark.createDataFrame([("p", canonical_json({"n": k})) for k in range(n)], "prompt string, inputs string"), r)


def test_calls_run_beside_each_other(spark, tmp_path):
    r = responder(str(tmp_path), wait=0.1)
    got = C.answer_within(asked(spark, r, 24), r, Budget(None))
    assert got.where("response is not null").count() == 24
    seen = calls(tmp_path)
    assert len(seen) == 24 and str(os.getpid()) not in {x[1] for x in seen}
    most = max(sum(float(b[2]) <= float(a[2]) < float(b[3]) for b in seen) for a in seen)
    assert most > 1
    for x in os.listdir(tmp_path):
        os.remove(tmp_path / x)
    C.answer_within(asked(spark, r, 12), r, Budget(None), parallel=1).count()
    seen = sorted(calls(tmp_path), key=lambda x: x[2])
    assert len(seen) == 12 and all(float(a[3]) <= float(b[2]) for a, b in zip(seen, seen[1:], strict=False))


@pytest.mark.parametrize(("limit", "size"), [(0, lambda n: 8), (40, lambda n: 8), (100, lambda n: 4 + 60 * (n % 5 == 0)), (100_000, lambda n: n), (33, lambda n: 200)])
def test_payments_stay_within_the_budget_and_nothing_is_asked_twice(spark, tmp_path, limit, size):
    r, budget, kept = responder(str(tmp_path), size), Budget(limit), []
    got = C.answer_within(asked(spark, r, 30), r, budget, persist=lambda df: kept.extend(x["response"] for x in df.collect())).collect()
    paid = [x for x in got if x["response"] is not None]
    assert len(got) == 30 and budget.used == sum(estimate(x["inputs"], x["response"]) for x in paid) <= limit
    assert sorted(kept) == sorted(x["response"] for x in paid)
    assert all(x["error"].startswith("BudgetExceeded") for x in got if x["response"] is None)
    seen = [x[0] for x in calls(tmp_path)]
    assert len(seen) == len(set(seen))
    cost = [estimate(canonical_json({"n": k}), canonical_json("x" * size(k))) for k in range(30)]
    if sum(cost) <= limit:
        assert len(paid) == 30
    elif min(cost) <= limit:
        # what is left couldn't pay for one of the answers that were had
        assert paid and limit - budget.used < max(cost)


def test_a_task_tried_again_finds_its_answers(tmp_path):
    (tmp_path / "log").mkdir()
    log, folder = str(tmp_path / "log"), f"file://{tmp_path}/journal"
    died = responder(log, fail=lambda n: KeyboardInterrupt() if n == 3 else LookupError("no") if n == 1 else None)
    rows = [(f"{k:02d}", "p", f'{{"n":{k}}}') for k in range(5)]
    with pytest.raises(KeyboardInterrupt):
        list(L.work(rows, died, L.Journal(folder), None))
    again = list(L.work(rows, responder(log), L.Journal(folder), None))
    assert [x[3] for x in again] == ["paid", "failed", "paid", "paid", "paid"]
    assert sorted(x[0] for x in calls(log)) == ["0", "1", "2", "3", "3", "4"]  # the call that died gave no answer
    # a lease that two answers use up, and one that covers none
    cost = again[0][2]
    assert [x[3] for x in L.work(rows, died, L.Journal(folder), 2 * cost + 1)] == ["paid", "failed", "paid", "unpaid", "left"]
    assert [x[3] for x in L.work(rows, died, L.Journal(folder), 0)] == ["unpaid", "left", "left", "left", "left"]
    assert len(calls(log)) == 6


def test_a_folder_that_stays_serves_another_run(spark, tmp_path):
    (tmp_path / "log").mkdir()
    log, folder = str(tmp_path / "log"), f"file://{tmp_path}/journal"
    r = responder(log)
    for _ in range(2):
        assert C.answer_within(asked(spark, r, 7), r, Budget(None), folder=folder).where("response is not null").count() == 7
    assert len(calls(log)) == 7


def test_setup_failures_end_the_rest(spark, tmp_path):
    r = responder(str(tmp_path), fail=lambda n: SetupError("no key"))
    told = []
    got = C.answer_within(asked(spark, r, 9), r, Budget(10**6), told=lambda *x: told.append(x[2])).collect()
    assert len(got) == 9 and {x["error"] for x in got} == {"SetupError: no key"} and told == [False] * 9
    assert len(calls(tmp_path)) < 9 or spark.sparkContext.defaultParallelism * L.TASKS_A_SLOT >= 9


def test_empty_and_hooks(spark, tmp_path):
    r = responder(str(tmp_path))
    got = C.answer_within(asked(spark, r, 0), r, Budget(0))
    assert got.count() == 0 and got.columns == [*C.KEY, "response", "error"]


def test_record_asks_once(spark, tmp_path):
    r = responder(str(tmp_path), fail=lambda n: ValueError("odd") if n == 2 else None)
    store = C.ResponseCache(spark.createDataFrame([], C.SCHEMA))
    store.record(C.answer_all(asked(spark, r, 10), r))
    assert store.entries.count() == 9 and store.snapshot().agg(F.max("response")).first()[0]
    assert (store.calls, store.errors, len(calls(tmp_path))) == (9, 1, 10)


def test_index_asks_in_executors_and_keeps_answers_when_the_budget_ends(spark, tmp_path):
    from lodestone.plans.index import Options, index
    from lodestone.respond.core import BudgetExceeded

    root, out, log = tmp_path / "r", str(tmp_path / "o"), tmp_path / "log"
    log.mkdir()
    for k in range(6):
        (root / f"lib{k}").mkdir(parents=True)
        (root / f"lib{k}" / "Cargo.toml").write_text(f'[package]\nname="l{k}"\n[lib]\n')

    class Surfaces:
        def call(self, prompt, inputs):
            with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
                f.write(f"{prompt}:{inputs.get('COMPONENT_ID')} {os.getpid()}")
            if prompt != "surface":
                return []
            return {"purpose": "p" * 40}

        def fingerprint(self):
            return Fingerprint("t", "o", "surfaces", "1")

    with pytest.raises(BudgetExceeded):
        index(spark, str(root), out, Surfaces(), Options(budget=110))
    first = calls(log)
    assert not os.path.exists(f"{out}/components.yaml") and os.path.exists(f"{out}/response-cache.json")
    r = index(spark, str(root), out, Surfaces(), Options(budget=10**6, parallel=2))
    every = calls(log)
    assert r.components.count() == 6 and str(os.getpid()) not in {x[1] for x in every}
    assert r.summary["calls"] < 7 <= len(every) and len(every) - len(first) == r.summary["calls"] and r.summary["tokens_used"] <= 10**6
    again = index(spark, str(root), out, Surfaces(), Options(budget=0))
    assert again.summary["calls"] == 0 and len(calls(log)) == len(every)
