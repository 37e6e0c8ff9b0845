"""What Python workers hold: the pipeline's check ran out of an executor's memory."""

import time

import pytest

pytest.importorskip("tessella.llm")
from tessella.llm import common, minhash  # noqa: E402


def test_sketches_are_compared_once(spark):
    """Not once for the column and once for the condition, in two workers a task."""
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    reps = spark.createDataFrame([(1, bytearray(b"abcd" * 64)), (2, bytearray(b"abcd" * 64)), (3, bytearray(b"zzzz" * 64))], "node long, sketch binary")
    found = minhash._likely(pairs, reps, minhash.Plan())
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r.a, r.b, r.matches) for r in found.collect()] == [(1, 2, 256)]


def _waited(condition):
    end = time.time() + 10
    while not condition() and time.time() < end:
        time.sleep(0.02)
    return condition()


def test_an_idle_worker_drops_its_tables(monkeypatch):
    monkeypatch.setattr(common, "IDLE_S", 0.2)
    built = []

    def task(hold):
        table = common.worker_table("idle test", lambda: built.append(1) or {})
        time.sleep(hold)
        yield common.worker_table("idle test", dict) is table

    # The next task finds the table, one that takes longer than IDLE_S keeps it.
    assert [*common.lean(task(0)), *common.lean(task(0.6))] == [True, True] and len(built) == 1
    assert _waited(lambda: not common._HELD)
    assert [*common.lean(task(0))] == [True] and len(built) == 2
    assert _waited(lambda: not common._HELD)
