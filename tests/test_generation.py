"""Generation with slow, failing and stuck calls, and what is asked again."""

import os
import pathlib
import threading
import time

import pytest

from millrace.operators.generation import Pool, generated


def test_pool_bounds_and_tries():
    live, most, tries = [0], [0], {}
    lock = threading.Lock()

    def ask(text):
        with lock:
            live[0] += 1
            most[0] = max(most[0], live[0])
            tries[text] = tries.get(text, 0) + 1
        time.sleep(0.02)
        with lock:
            live[0] -= 1
        if text.startswith("never"):
            raise OSError(text)
        if text.startswith("second") and tries[text] < 2:
            return None
        return text.upper()

    texts = [f"t{i}" for i in range(20)] + ["never", "second", None]
    got = Pool(threads=4, seconds=5, tries=3).answers(texts, ask)
    assert got == [f"T{i}" for i in range(20)] + [None, "SECOND", None]
    assert 1 < most[0] <= 4 and tries["never"] == 3 and tries["second"] == 2 and tries["t0"] == 1


def test_time_limits():
    began = time.monotonic()
    ask = lambda t: time.sleep(30) if t == "stuck" else t
    got = Pool(threads=2, seconds=0.2, tries=2).answers(["a", "stuck", "b", "stuck", "c"], ask)
    assert got == ["a", None, "b", None, "c"] and time.monotonic() - began < 5
    got = Pool(threads=1, seconds=0.05, tries=1, stuck_most=2).answers(["stuck"] * 5 + ["a"], ask)
    assert set(got) <= {None, "a"} and time.monotonic() - began < 8
    assert Pool().answers([], ask) == []


def logged(folder, ask):
    """ask, with a file for each call of a row."""
    pathlib.Path(folder).mkdir()

    def run(text):
        (pathlib.Path(folder) / f"{text}-{time.time_ns()}").touch()
        return ask(text)

    return run


def calls(folder):
    return sorted(p.name.rpartition("-")[0] for p in pathlib.Path(folder).iterdir())


def test_later_runs_ask_for_the_rest(spark, tmp_path):
    todo = spark.createDataFrame([(i, f"t{i}") for i in range(30)] + [(99, None)], "unique_id long, text string").repartition(3)
    path, pool = f"file://{tmp_path}/progress", Pool(tries=1, chunk=4)
    first = logged(tmp_path / "a", lambda t: None if int(t[1:]) % 3 == 0 else t + "!")
    got = {r["unique_id"]: r["raw_resp"] for r in generated(todo, "text", first, path, pool, 5).collect()}
    assert got == {i: f"t{i}!" for i in range(30) if i % 3} and len(calls(tmp_path / "a")) == 30
    second = logged(tmp_path / "b", lambda t: t + "?")
    got = {r["unique_id"]: r["raw_resp"] for r in generated(todo.union(spark.createDataFrame([(50, "t50")], todo.schema)), "text", second, path, pool, 5).collect()}
    assert got == {i: f"t{i}" + ("!" if i % 3 else "?") for i in range(30)} | {50: "t50?"}
    assert calls(tmp_path / "b") == sorted([f"t{i}" for i in range(0, 30, 3)] + ["t50"])


def test_a_task_that_is_lost_halfway(spark, tmp_path):
    """The second attempt asks only for what the first had not saved."""
    todo = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "unique_id long, text string").coalesce(1)
    path, pool = str(tmp_path / "progress"), Pool(threads=1, tries=1, chunk=5)

    flag = tmp_path / "lost"

    def ask(text):
        if text == "t22" and not flag.exists():
            flag.touch()
            os._exit(1)  # the Python worker goes, and its task with it
        return text + "!"

    own = logged(tmp_path / "a", ask)
    out = lambda: generated(todo, "text", own, path, pool, 1)  # noqa: E731  a plan of its own each time
    with pytest.raises(Exception):  # noqa: B017  whatever Spark makes of it
        out().collect()  # local mode gives a task one attempt
    assert flag.exists() and 20 < len(calls(tmp_path / "a")) <= 25
    assert {r["unique_id"]: r["raw_resp"] for r in out().collect()} == {i: f"t{i}!" for i in range(40)}
    assert len(calls(tmp_path / "a")) <= 45 and set(calls(tmp_path / "a")) == {f"t{i}" for i in range(40)}
