"""Phrase collocations against brute force, with filters of any size and texts cut anywhere."""

import random
import re
from collections import Counter

import pytest

from claimspark.llm import collocations as co


def brute_force(rows, least, longest=5, share=100, top=2000):
    counts, total = Counter(), Counter()
    for _, text, lang in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang or "und", tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    often = {p: n for p, n in counts.items() if n >= least}
    best: dict[tuple, int] = {}
    for (lang, p), n in often.items():
        for i in range(len(p)):
            for j in range(i + 1, len(p) + 1):
                if j - i < len(p):
                    best[lang, p[i:j]] = max(best.get((lang, p[i:j]), 0), n)
    out = []
    for (lang, p), a in often.items():
        if len(p) > 1 and 100 * best.get((lang, p), -1) < share * a:
            n = total[lang]
            score, k = min((1000 * a * n // (often[lang, p[:k]] * often[lang, p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, " ".join(p), a, often[lang, p[:k]], often[lang, p[k:]], n, score, k))
    ranked, place = [], Counter()
    for r in sorted(out, key=lambda r: (-r[6], -r[2], r[1].encode())):
        place[r[0]] += 1
        if place[r[0]] <= top:
            ranked.append((r[0], place[r[0]], *r[1:]))
    return sorted(ranked)


def texts(n, words, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)] + ["É", "a\x01", "a", "A", "日本", "🙂", "a!b", "#"]
    out = []
    for _ in range(n):
        out.append("".join(rng.choice(vocabulary[:rng.choice([3, 6, len(vocabulary)])]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\x0b"]) for _ in range(rng.randrange(60))))
    return out


ODD = ([(k, t, ["en", "de", None, "und"][k % 4]) for k, t in enumerate(texts(160, 12, 1))]
       + [(1, None, "en"), (2, "", None), (3, " \t.\n", "en"), (4, "one two three " * 60, "x"), (None, "Strong coffee, " * 40, "en"), (5, "fixed phrase here. " * 30, "y"), (5, "fixed phrase here. " * 30, "y"),
          (6, "same " * 3000, "z")])


def table(spark, rows):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for c in ("n", "phrase", "path", "part", "rank", "place", "size", "hash", "cell"):
        df = df.withColumn(c, F.lit("x"))
    return df


def run(df, **options):
    return sorted(tuple(r) for r in co.collocations(df, **options).collect())


@pytest.mark.parametrize("options", [{"least": 5}, {"least": 2, "bits": 1 << 15}, {"least": 12, "longest": 3, "share": 60, "top": 4}, {"least": 5, "bits": 8}])
def test_brute_force(spark, options):
    want = brute_force(ODD, **{k: v for k, v in options.items() if k != "bits"})
    assert len(want) > 4
    assert run(table(spark, ODD), **options) == want


def test_many_ranges_of_a_stream(spark):
    """Every range of a stream gets the beginnings of its first path, also where one word begins nearly all phrases."""
    rows = [(k, "hot " + t.replace(".", " hot ").replace(",", " hot "), "en") for k, t in enumerate(texts(120, 5, 2))]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert run(table(spark, rows), least=3) == brute_force(rows, 3)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "a b", "en")]])
def test_tiny(spark, rows):
    assert run(table(spark, rows), least=2) == [] and run(table(spark, rows), least=1) == brute_force(rows, 1)


def test_slices_keep_every_word(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(co, "SLICE", 50)
    batch = pa.RecordBatch.from_pydict({"lang": ["a", "b", "a"], "text": ["One two, three. " * 30, "x" * 300, "no end " * 50]})
    got = {lang: [] for lang in "ab"}
    for lang, words in co.slices(batch):
        got[lang] += [w for w in words if w != co.END]
    assert Counter(got["a"]) == Counter({b"one": 30, b"two": 30, b"three": 30, b"no": 50, b"end": 50}) and got["b"] == [b"x" * 300]


def test_exact_score_beyond_64_bits():
    assert co.best_cut(10 ** 12, 10 ** 16, [10 ** 13], [10 ** 12 + 1]) == (1000 * 10 ** 28 // (10 ** 13 * (10 ** 12 + 1)), 1, 10 ** 13, 10 ** 12 + 1)


def test_tasks_give_a_phrase_once():
    """Partial counts are combined over a task, not only over a run of words, and all are given where too many differ."""
    import pyarrow as pa
    rows = [co._rows("en", pa.array([b"a b", b"c d"]), [3, 1]), co._rows("de", pa.array([b"a b"]), [5]), co._rows("en", pa.array([b"a b", "\u00e9 f".encode()]), [4, 9])]
    got = [tuple(r.values()) for b in co.combined(iter(rows)) for r in b.to_pylist()]
    assert sorted(got) == [("de", "a b", 5), ("en", "a b", 7), ("en", "c d", 1), ("en", "\u00e9 f", 9)]
    many = [co._rows("en", pa.array([f"w{k} x".encode() for k in range(50)] + [b"a b"]), [1] * 51) for _ in range(3)]
    total = Counter()
    for most in (1, 60, 10 ** 6):
        total.clear()
        for b in co.combined(iter(many), most):
            total.update(dict(zip(b.column(1).to_pylist(), [0] * b.num_rows)))
            for r in b.to_pylist():
                total[r["phrase"]] += r["n"]
        assert total["a b"] == 3 and sum(total.values()) == 153
    assert list(co.combined(iter([]))) == []


def test_rare_triples_of_frequent_pairs_are_not_given(spark):
    """The last count gives phrases of three words and more only where their three-word parts may be frequent."""
    import numpy as np
    import pyarrow as pa
    texts = ["a b c"] * 30 + ["a b", "b c"] * 30 + [f"b c d{k}. a b d{k}. c d{k}" for k in range(30)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * len(texts), "text": texts})
    bits, least = 1 << 20, 25
    words = np.full(bits // 8, 255, np.uint8)
    filters = []
    for _ in range(2):
        held = np.zeros(bits, np.int64)
        for out in co.count_cells(iter([batch]), words, filters, bits):
            for row, cells in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
                n = len(cells) // 6
                held[row * 32768 + np.frombuffer(cells, "<u2", n).astype(np.int64)] += np.frombuffer(cells, "<u4", n, 2 * n)
        filters.append(np.packbits(held >= least, bitorder="little"))
    got = Counter()
    for b in co.count_phrases(iter([batch]), words, filters, 5):
        got.update({r["phrase"]: r["n"] for r in b.to_pylist()})
    assert got == {"a b": 90, "b c": 90, "a b c": 30}
