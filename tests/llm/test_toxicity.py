import zlib

import numpy as np

from claimspark.llm import toxicity as T
from claimspark.llm.catalog import op5_toxicity


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.1"
    rows = op5_toxicity(spark, folder).toPandas()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all()
    assert (rows.predicted == (rows.score >= 0.3)).all() and rows.score.between(0, 1).all()
    both = rows.merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id")
    both = both[both.held_out & both.toxic.notna()]
    rank = both.score.rank()
    pos = (both.toxic == 1).to_numpy()
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    hit = (both.predicted == 1) & pos
    assert auc > 0.9 and hit.sum() / pos.sum() > 0.65 and hit.sum() / (both.predicted == 1).sum() > 0.65


def toy(n=120):
    rng = np.random.default_rng(1)
    plain, bad = ["garden", "window", "river", "stone", "paper", "music"], ["blorgish", "blorgful", "blorger"]
    rows = []
    for k in range(n):
        words = list(rng.choice(plain, 40))
        if k % 3 == 0:
            words[5:8] = rng.choice(bad, 3)
        rows.append((k, " ".join(words), int(k % 3 == 0)))
    return rows


def test_misspellings_share_subwords():
    rows = toy()
    scores, bias = T.bucket_scores(T.fit([r[1] for r in rows], np.array([r[2] for r in rows])))
    words = T.WordScores(scores)
    assert words["blorgisch"] > 10 + words["gardenn"] and words["blorgishly"] > 10 + words["rivers"]


def test_odd_rows(spark, docs_of, nasty):
    labels = spark.createDataFrame([(k, None, y) for k, _, y in toy()] + [(None, 1, 1), (5000, 1, None), (0, 1, 0)], "doc_id long, quality int, toxic int")
    docs = docs_of([(k, t) for k, t, _ in toy()] + [(9000 + k, t) for k, (_, t) in enumerate(nasty)] + [(None, "blorgish blorger blorgful")])
    model = T.train(docs, labels)
    rows = T.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert [r.score for r in rows if r.doc_id is None][0] > 0.9
    assert sum(r.predicted != (r.doc_id % 3 == 0) for r in rows if r.doc_id is not None and r.doc_id < 120) == 0
    again = T.train(docs, labels)
    assert all((model[k] == again[k]).all() for k in model)
    none = spark.createDataFrame([], labels.schema)
    assert T.score(docs, T.train(docs, none)).count() == docs.count()
    assert T.score(docs_of([]), model).count() == 0


def test_sample_is_bounded_and_never_held_out(spark, docs_of):
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(400)], "doc_id long, quality int, toxic int")
    got = T.fit_sample(docs_of([(k, "x") for k in range(400)]), T.known_labels(labels), max_per_class=20).collect()
    assert len(got) == 40 and not any(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)


def test_one_long_labelled_text_does_not_end_the_sample(spark, docs_of):
    rows = [(0, "river stone " * 2000, 0)] + [(k + 1, t, y) for k, t, y in toy()]
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in rows], "doc_id long, quality int, toxic int")
    docs = docs_of([(k, t) for k, t, _ in rows])
    # as many characters as all the others have, fewer than the long one
    model = T.train(docs, labels, max_chars=20_000)
    got = {r.doc_id: r.predicted for r in T.score(docs, model).collect()}
    assert len(rows[0][1]) > 20_000 and all(got[k] == y for k, _, y in rows[1:])


def test_each_class_has_its_share_of_the_characters():
    import pandas as pd

    rows = pd.DataFrame([(k, int(k >= 60), "x" * (1000 if k < 60 else 100)) for k in range(80)] + [(100, 1, "y" * 50_000)], columns=["doc_id", "toxic", "text"])
    kept = T.within(rows, 20_000)
    assert kept["text"].str.len().sum() <= 20_000
    assert (kept.toxic == 1).sum() == 20 and (kept.toxic == 0).sum() == 10
    assert T.within(rows, 10**9).equals(rows)
    alone = T.within(rows.iloc[[0, 80]], 500)
    assert sorted(zip(alone.toxic, alone.text.str.len())) == [(0, 250), (1, 250)]


def plain_score(text, model):
    """Each word's vector is the mean of its n-grams' embeddings; their average goes through the softmax, shifted to the share of the labels."""
    place = {int(b): k for k, b in enumerate(model["buckets"])}
    letters = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    total = np.zeros(T.DIM)
    for word in letters:
        whole = f"<{word}>"
        parts = [whole] + [whole[i:j] for i in range(len(whole)) for j in range(i + 3, min(i + 6, len(whole)) + 1)]
        for part in parts:
            at = place.get(zlib.crc32(part.encode()) % T.BUCKETS)
            if at is not None:
                total += model["embedding"][at].astype(float) / len(parts)
    mean = T.SCALE * total / max(len(letters), T.LEAST_WORDS)
    share = min(max(float(model["share"]), 0.005), 0.995)
    logits = mean @ model["softmax"].astype(float) + model["bias"][0].astype(float) + np.log([1 - share, share])
    e = np.exp(logits - logits.max())
    return float((e / e.sum())[1])


def test_scores_equal_a_plain_softmax(spark, docs_of, nasty, sf_small):
    given = spark.read.parquet(f"{sf_small}/documents.parquet")
    model = T.train(given, spark.read.parquet(f"{sf_small}/labels.parquet"))
    odd = docs_of([(9000 + k if i is not None else None, t) for k, (i, t) in enumerate(nasty)] + [(9999, "é_Ä 日本-語 naïve ９ x")])
    for docs in (given, odd):
        texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        want = sorted(((i, plain_score(t, model)) for i, t in texts), key=repr)
        got = sorted(((r.doc_id, r.score) for r in T.score(docs, model).collect()), key=repr)
        assert [i for i, _ in got] == [i for i, _ in want]
        assert np.allclose([s for _, s in got], [s for _, s in want], atol=1e-4)
        sure = [(i, t) for i, t in texts if abs(plain_score(t, model) - 0.3) > 1e-3]
        kept = [(r.doc_id, r.text) for r in T.clean_rows(docs, model).select("doc_id", "text").collect()]
        assert all((kept.count(row) > 0) == (plain_score(row[1], model) < 0.3) for row in sure)
