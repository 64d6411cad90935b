"""Each stage on its own input, against brute force, and the whole run."""

import re
from collections import Counter

import duckdb

import corpus_pipeline as P
from claimspark.llm import catalog, toxicity
from claimspark.llm.common import write_shared

from .test_exact_dedup import brute_force as equal_texts
from .test_jaccard_join import brute_force as near_texts
from .test_packing_tokens import check_packed, ids_of, library  # noqa: F401


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def whole_copies(docs):
    """Copies of each document, by SQL that lists quotas quotient by quotient: a shard's documents ``passes`` times, and once
    more in seeded order up to the document whose middle the rest of its quota reaches."""
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    upto = catalog.OP2_SQL[:catalog.OP2_SQL.index("blk AS (")].rstrip().rstrip(",")
    found = con.sql(f"{upto} SELECT doc_id, CASE WHEN size > 0 THEN passes + CASE WHEN 2 * low + size <= 2 * rest THEN 1 ELSE 0 END ELSE 0 END AS copies FROM p").fetchall()
    return Counter({d: int(n) for d, n in found})


def test_run_stage_by_stage(spark, sf_small, library):  # noqa: F811
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_small}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.score(docs, model).collect() if r.predicted == 1}
    expected = {d: t for d, t in rows(docs) if d not in rejected}
    for k, (name, stage) in enumerate(P.STAGES):
        out = write_shared(stage(spark, docs, sf_small), "test")
        if k < 4:
            assert out.columns == docs.columns
        if k == 1:
            expected = {d: expected[d] for d, keep, *_ in equal_texts(list(expected.items())) if d == keep}
        elif k == 2:
            expected = {d: expected[d] for d, _, c in near_texts(list(expected.items()), 5, 80) if d == c}
        elif k == 3:
            copies = whole_copies(docs)
            assert Counter(rows(out)) == +Counter({(d, t): copies[d] for d, t in expected.items()})
        elif k == 4:
            check_packed(out.collect(), [(d, ids_of(library, t) + [0]) for d, t in rows(docs)], 2048)
        if k < 3:
            assert sorted(rows(out)) == sorted(expected.items()), name
        docs = out
    again = P.run(spark, sf_small)
    assert sorted(again.drop("sequence_id", "offset").collect()) == sorted(docs.drop("sequence_id", "offset").collect())


def test_stages_on_odd_rows(spark, docs_of, nasty, sf_small):
    extra = [(200, " near copy " + " ".join(f"w{k}" for k in range(60))), (201, "near copy " + " ".join(f"w{k}" for k in range(60)) + " more"), (201, "other")]
    for source in ([], nasty + extra):
        docs = docs_of(source)
        for name, stage in P.STAGES:
            out = write_shared(stage(spark, docs, sf_small), "odd")
            if name != "best-fit packing":
                assert out.columns == docs.columns
                assert not set(map(repr, rows(out))) - set(map(repr, source))
            docs = out
        texts = [t for _, t in rows(write_shared(P.distinct_texts(spark, docs_of(source), sf_small), "odd"))]
        assert len(texts) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in source})
    kept = rows(P.distinct_shingles(spark, docs_of(extra), sf_small))
    assert sorted(kept) == sorted([extra[0], extra[2]])
