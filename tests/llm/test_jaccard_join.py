import random
import re

import numpy as np
import pytest

from claimspark.llm import jaccard_join as J
from claimspark.llm.components import components, stars


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + width]) for i in range(max(len(words) - width + 1, min(1, len(words))))}


def brute_force(rows, width, percent):
    sets = [shingle_set(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                root[find(x)] = find(y)
    least = {}
    for k, (d, _) in enumerate(rows):
        r = find(k)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    return sorted(((d, len(s), least[find(k)]) for k, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def corpus(seed, n=150, vocabulary=12):
    """Families of near copies over few words, chains, shared passages and short texts."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)]
    passage = [rng.choice(words) for _ in range(30)]
    rows, bases = [], [[rng.choice(words) for _ in range(rng.choice([1, 2, 3, 8, 25, 60, 150]))] for _ in range(12)]
    for k in range(n):
        text = list(rng.choice(bases))
        if rng.random() < 0.3:
            text += passage
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            text[rng.randrange(len(text))] = rng.choice(words + [f"new{k}"])
        rows.append((k * 7 % 1000, " ".join(text).upper() if k % 5 == 0 else "\n".join(text)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(docs_of, seed):
    rows = corpus(seed)
    assert got(J.jaccard_components(docs_of(rows))) == brute_force(rows, 3, 90)


def test_other_widths_and_split_families(docs_of):
    rows = corpus(9, n=120)
    assert got(J.jaccard_components(docs_of(rows), width=5, percent=80)) == brute_force(rows, 5, 80)
    assert got(J.jaccard_components(docs_of(rows), width=3, percent=80, family_members=60)) == brute_force(rows, 3, 80)


def test_edge_rows(docs_of, nasty):
    rows = nasty + [(30, "A b c d"), (31, "a b c d"), (31, "other text here"), (None, None), (40, "two words"), (41, "TWO words"), (42, "words two")]
    assert got(J.jaccard_components(docs_of(rows))) == brute_force(rows, 3, 90)
    assert got(J.jaccard_components(docs_of([]))) == []


def test_given_table(spark, sf_small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    from claimspark.llm.catalog import op8_jaccard_join
    assert got(op8_jaccard_join(spark, sf_small)) == brute_force(rows, 3, 90)


def test_prefix_length():
    for n in range(1, 400):
        for percent in (80, 85, 90, 100):
            assert J.prefix_length(n, percent) == n - -(-n * percent // 100) + 1


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(300)] + [(1000, 2000 + k) for k in range(300)] + [(k, k) for k in range(5000, 5003)]
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    rng.shuffle(edges)
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.component) for r in rows} == {(k, 0) for k in range(301)} | {(k, 1000) for k in [1000, *range(2000, 2300)]} and len(rows) == 602
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert np.iinfo(np.int64).min <= J.node_of(np.empty(0, np.uint64)) <= np.iinfo(np.int64).max


def stages_of(spark, action):
    """Spark's stages that the action ran, and what it gave."""
    sc, group = spark.sparkContext, f"stages-{random.random()}"
    sc.setJobGroup(group, group)
    try:
        found = action()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    jobs = map(tracker.getJobInfo, tracker.getJobIdsForGroup(group))
    return len({s for job in jobs for s in job.stageIds}), found


def test_few_edges_take_few_stages(spark):
    """A path needs many rounds of stars, whose stages the driver has to remember; a task joins up a short one."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(3000)], "a long, b long")
    stages, rows = stages_of(spark, lambda: components(edges).collect())
    assert {tuple(r) for r in rows} == {(k, 0) for k in range(3001)} and len(rows) == 3001
    assert stages <= 20


@pytest.mark.parametrize("task_edges", [1, 40, 700])
def test_components_of_more_edges_than_a_task_joins_up(spark, task_edges):
    rng = random.Random(task_edges)
    edges = [(k, k + 1) for k in range(300)] + [(1000, 2000 + k) for k in range(300)] + [(3000 + rng.randrange(200), 3000 + rng.randrange(200)) for _ in range(150)]
    edges += [(-(1 << 63), (1 << 63) - 1), (4000, 4000)]
    least = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(len(edges)):
        before = dict(least)
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
        if least == before:
            break
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    rng.shuffle(edges)
    rows = components(spark.createDataFrame(edges, "a long, b long").repartition(5), task_edges=task_edges).collect()
    assert {tuple(r) for r in rows} == set(least.items()) and len(rows) == len(least)


def test_stars():
    a, b = stars(np.array([9, 7, 5, -3, 30]), np.array([7, 5, 6, -8, 20]))
    assert dict(zip(a.tolist(), b.tolist())) == {6: 5, 7: 5, 9: 5, -3: -8, 30: 20}


@pytest.mark.parametrize("shared", [7, None])
def test_texts_under_one_id_are_fetched_once(docs_of, monkeypatch, shared):
    """Each set's text is fetched once where many documents share its id."""
    words = [f"w{k}" for k in range(60)]
    rows = [(shared, " ".join(words + [f"tail{k}"])) for k in range(40)] + [(100 + k, f"a b c d {k}") for k in range(5)]
    fetched = []
    plan = type(docs_of([])).mapInArrow

    def counted(df, func, schema):
        if "blocks" in df.columns:
            fetched.append(df.count())
        return plan(df, func, schema)

    monkeypatch.setattr(type(docs_of([])), "mapInArrow", counted)
    assert got(J.jaccard_components(docs_of(rows))) == brute_force(rows, 3, 90)
    assert fetched == [40]
