"""The words that whole copies realise, against each source's target."""

import random
from collections import Counter

from claimspark.llm import mixing


def corpus(tiny):
    rng = random.Random(5)
    rows = []
    for source in "abc":
        for _ in range(120):
            n = rng.choice([20, 60, 150, 400, 2500])
            rows.append((len(rows), " ".join(f"{source}{len(rows)}x{k}" for k in range(n)), source))
    if tiny:
        rows.append((len(rows), "tiny " * 100, "d"))
    return rows


def check(spark_docs, rows):
    docs = spark_docs(rows)
    target = {r.source: r.target for r in mixing.source_targets(mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id")
              .select("source", "source_size").distinct()).collect()}
    realised, long_ones = Counter(), Counter()
    for r in mixing.mixed(docs).collect():
        n = len(r.text.split())
        realised[r.source] += n
        long_ones[r.source] += n == 2500
    for source, words in target.items():
        longest = max(len(t.split()) for _, t, s in rows if s == source)
        assert abs(realised[source] - words) <= longest / 2 + 1024, (source, realised[source], words)
    assert all(long_ones[s] for s in "abc")


def test_realised_words_are_near_the_target(docs_of):
    check(docs_of, corpus(False))


def test_one_tiny_source_changes_nothing_for_the_others(docs_of):
    check(docs_of, corpus(True))


def test_documents_of_one_id_are_told_apart(docs_of):
    rows = [(None, f"word{k} " * 10, "a") for k in range(50)] + [(7, f"other{k} " * 10, "b") for k in range(50)]
    got = Counter(r.source for r in mixing.mixed(docs_of(rows)).collect())
    target = {"a": 1000 * 5 / 7, "b": 1000 * 2 / 7}
    assert all(abs(10 * got[s] - target[s]) <= 10 + 8 for s in target)
