import random
import re
from collections import defaultdict

from kittiwake.llm.copies import SortedRuns, collapse_people, person_runs

USER = "id long, name string, email string, key string, part int, first_id string"


def key(name, email):
    if name is None or email is None:
        return None
    n, e = re.findall(r"[^\W_]+", name.lower()), re.findall(r"[^\W_]+", email.lower())
    return (tuple(sorted(n)), "".join(e)) if n and e else None


def noisy(rng, text):
    return "".join(rng.choice((c, c.upper())) for c in text) + rng.choice(["", ".", " ", "　", "​", "_"])


def sample():
    rng = random.Random(8)
    people = [("Ana B Öst", "ana.b@x.test")] + [(f"N{k} Fam{k % 7}", f"n{k}@x.test") for k in range(40)]
    rows = []
    for i in range(600):
        n, e = people[0] if rng.random() < 0.4 else rng.choice(people)
        w = n.split()
        rng.shuffle(w)
        rows.append((i, noisy(rng, rng.choice((" ", ", ", " ")).join(w)), noisy(rng, e)))
    return rows + [(700, None, "a@b"), (701, "x", None), (702, "", "a@b"), (703, "--", "a@b"), (None, "Ana B Öst", "ana.b@x.test"), (5, rows[5][1], rows[5][2]), (704, "w " * 40000, "long@x.test"), (705, "w " * 40000, "LONG@x.test")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], USER)


def test_against_brute_force(spark):
    rows = sample()
    groups = defaultdict(list)
    for i, n, e in rows:
        if (k := key(n, e)) is not None:
            groups[k].append(i)
    runs = person_runs(frame(spark, rows).repartition(5))
    found = [tuple(r) for r in runs.members().collect()]
    want = {(min(x for x in g if x is not None), i) for g in groups.values() for i in g if i is not None and i != min(x for x in g if x is not None)}
    assert len(found) == len(set(found)) and set(found) == want
    counts = sorted((r.first_id, r.copies) for r in runs.counts().collect())
    assert counts == sorted((min(x for x in g if x is not None), len(g)) for g in groups.values())


def test_runs_over_several_partitions(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(k, "same" if 10 <= k < 900 else f"k{k}") for k in range(1000)], "id long, k string")
        runs = SortedRuns(df, df.k)
        assert runs.rows.select("part").distinct().count() > 2
        assert {tuple(r) for r in runs.members().collect()} == {(10, k) for k in range(11, 900)}
        assert sorted((r.first_id, r.copies) for r in runs.counts().collect()) == sorted([(10, 890)] + [(k, 1) for k in (*range(10), *range(900, 1000))])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_empty(spark):
    runs = person_runs(frame(spark, []))
    assert runs.members().count() == 0 and runs.counts().count() == 0


def test_one_record_of_each(spark):
    rows = sample()
    groups = defaultdict(list)
    for i, n, e in rows:
        if (k := key(n, e)) is not None:
            groups[k].append(i)
    got = {r.id: (r.copies, r.name, r.key) for r in collapse_people(frame(spark, rows)).collect()}
    first = {min(x for x in g if x is not None): len(g) for g in groups.values()}
    assert {i: n for i, (n, _, _) in got.items()} == first and all(name == dict((i, n) for i, n, _ in rows)[i] and k == "clash" for i, (_, name, k) in got.items())
    assert collapse_people(frame(spark, [])).count() == 0
