import random
import threading

import pytest
from hypothesis import given
from hypothesis import strategies as st

from kittiwake.operators.incremental import Gap, Intervals, Ledger, gaps_of_runs, label_by_gap, new_versions_by_run
from kittiwake.sources.files import Files

pairs = st.lists(st.tuples(st.integers(0, 60), st.integers(0, 12)).map(lambda p: (p[0], p[0] + p[1])), max_size=8)


@given(pairs, pairs)
def test_intervals_are_sets(a, b):
    numbers = lambda ps: {n for lo, hi in ps for n in range(lo, hi + 1)}
    x, y = Intervals(a), Intervals(b)
    assert numbers((x | y).pairs) == numbers(a) | numbers(b)
    assert numbers((x - y).pairs) == numbers(a) - numbers(b)
    assert all(u[1] + 1 < v[0] for u, v in zip((x - y).pairs, (x - y).pairs[1:]))
    assert all((n in x) == (n in numbers(a)) for n in range(-1, 75))


def test_failed_runs_commit_nothing():
    runs = [(1, 2, "ok"), (2, 5, "failed"), (3, 6, "killed"), (4, 6, "ok"), (5, 6, "ok"), (6, None, "ok"), (7, 9, None)]
    assert [(g.lo, g.hi, g.run) for g in gaps_of_runs(runs)] == [(1, 2, 1), (3, 6, 4)]


def brute(feed, runs):
    out, previous = set(), 0
    for run, upto, status in sorted(runs):
        if status != "ok" or upto is None:
            continue
        for i in {r[1] for r in feed if r[1] is not None}:
            new = [v for b, k, v in feed if k == i and b is not None and v is not None and previous < b <= upto]
            old = [v for b, k, v in feed if k == i and b is not None and v is not None and b <= previous]
            if new and (not old or max(old) < max(new)):
                out.add((run, i, max(new)))
        previous = max(previous, upto)
    return out


def test_new_versions_against_brute_force(spark):
    rng = random.Random(4)
    feed = [(rng.randint(1, 12), 7 if rng.random() < 0.4 else rng.randint(1, 20), rng.randint(-5, 30)) for _ in range(600)]
    feed += [(None, 1, 99), (3, None, 99), (3, 1, None)] + feed[:50]
    runs = [(1, 0, "ok"), (2, 3, "failed"), (4, 4, "ok"), (5, 4, "ok"), (6, 9, "killed"), (8, 10, "ok")]
    f = spark.createDataFrame([(*r, "x", 1) for r in feed], "batch int, id long, ver int, _k string, run_id int")
    r = spark.createDataFrame([(*r, "extra") for r in runs], "run_id long, upto_batch int, status string, id string")
    got = [tuple(x) for x in new_versions_by_run(f, r, seq="batch", key="id", version="ver").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(feed, runs)


def test_empty_tables(spark):
    f = spark.createDataFrame([], "batch int, id long, ver int")
    r = spark.createDataFrame([], "run_id long, upto_batch int, status string")
    assert new_versions_by_run(f, r, seq="batch", key="id", version="ver").count() == 0
    r = spark.createDataFrame([(1, 3, "ok")], "run_id long, upto_batch int, status string")
    assert new_versions_by_run(f, r, seq="batch", key="id", version="ver").count() == 0


def test_many_gaps_are_searched(spark):
    gaps = [Gap(10 * k, 10 * k + 4, k, k) for k in range(700)]
    rows = spark.createDataFrame([(n,) for n in (0, 4, 5, 6990, 6994, 6995, -1, None)], "n long")
    assert [r[0] for r in rows.select(label_by_gap(rows.n, gaps)).collect()] == [0, 0, None, 699, 699, None, None, None]


def test_ledger_survives_failure_and_late_rows(spark, tmp_path):
    ledger = Ledger(str(tmp_path / "job"))
    feed = spark.createDataFrame([(n, f"r{n}") for n in (1, 2, 4, 5)], "seq long, v string")
    assert ledger.run(feed, "seq", Intervals([(1, 2), (4, 5)])) == Intervals([(1, 2), (4, 5)])

    def broken(rows):
        raise RuntimeError("lost")

    late = feed.union(spark.createDataFrame([(3, "late"), (6, "r6")], "seq long, v string"))
    with pytest.raises(RuntimeError, match="lost"):
        ledger.run(late, "seq", Intervals([(1, 6)]), broken)
    assert ledger.done() == Intervals([(1, 2), (4, 5)])
    assert ledger.run(late, "seq", Intervals([(1, 6)])) == Intervals([(3, 3), (6, 6)])
    assert not ledger.run(late, "seq", Intervals([(1, 6)]))
    assert sorted(r.seq for r in ledger.output(spark).collect()) == [1, 2, 3, 4, 5, 6]


def test_two_writers_cannot_both_commit(spark, tmp_path):
    ledger = Ledger(str(tmp_path / "job"))
    feed = spark.createDataFrame([(1,)], "seq long")

    def meanwhile(rows):
        Ledger(str(tmp_path / "job")).run(feed, "seq", Intervals([(1, 1)]))
        return rows

    with pytest.raises(RuntimeError, match="another run"):
        ledger.run(feed, "seq", Intervals([(1, 1)]), meanwhile)
    assert ledger.output(spark).count() == 1


def test_races_lose_no_commit(spark, tmp_path):
    first, second = (Ledger(str(tmp_path / "job"), spark) for _ in range(2))
    old = first.state()
    results = []

    def commit(ledger, lo, name):
        try:
            ledger._commit(old, Intervals([(lo, lo + 9)]), name)
            results.append((lo, name))
        except RuntimeError:
            pass

    runs = [threading.Thread(target=commit, args=(x, lo, n)) for x, lo, n in ((first, 1, "run-a"), (second, 11, "run-b"))]
    for t in runs:
        t.start()
    for t in runs:
        t.join()
    # exactly one of two commits to one version succeeds, and the state is what that one wrote
    assert len(results) == 1 and first.state()["outputs"] == [results[0][1]] and first.done() == Intervals([(results[0][0], results[0][0] + 9)])


def test_names_are_taken_once_on_any_file_system(spark, tmp_path):
    files = Files(spark, str(tmp_path))
    for local in (True, False):
        files.local = local
        files.publish(f"a-{local}", "one")
        with pytest.raises(FileExistsError):
            files.publish(f"a-{local}", "two")
        assert files.read(f"a-{local}") == "one"
    assert set(files.list()) == {"a-True", "a-False"}
