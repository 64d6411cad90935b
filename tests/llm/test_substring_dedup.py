import hashlib
import random
import re

import pytest

from claimspark.llm import substring_dedup as S


def brute_force(rows, window):
    """On rows whose ids differ, or that are equal."""
    docs = {(d is None, d or 0): re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    seen, out = set(), {}
    for key in sorted(docs):
        words, gone = docs[key], set()
        for k in range(len(words) - window + 1):
            w = tuple(words[k:k + window])
            if w in seen:
                gone.update(range(k, k + window))
            seen.add(w)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out[key] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return sorted(((d, *out[d is None, d or 0]) for d, _ in rows), key=repr)


def got(df):
    return sorted((tuple(r)[:4] for r in df.collect()), key=repr)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(rng.choice([2, 6, 400]))]
    passages = [[rng.choice(words) for _ in range(rng.choice([4, 19, 20, 21, 50, 90]))] for _ in range(5)]
    rows = []
    for k in range(n):
        text = []
        for _ in range(rng.choice([1, 2, 5])):
            text += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(words + [f"x{k}"]) for _ in range(rng.choice([1, 10, 30]))]
        rows.append((rng.choice([-1, 1]) * k, rng.choice([" ", "\n", "\t "]).join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("slice_words", [300, 1_000_000])
def test_against_brute_force(docs_of, seed, slice_words):
    rows = corpus(seed)
    window = (20, 7)[seed % 2]
    assert got(S.substring_dedup(docs_of(rows).repartition(6), window=window, slice_words=slice_words)) == brute_force(rows, window)


def test_edge_rows(docs_of, nasty):
    rows = nasty + [(30, "word " * 19), (31, "word " * 20), (32, "word " * 21), (33, " ".join(f"a{k}" for k in range(40))), (34, "z " + " ".join(f"a{k}" for k in range(5, 30)))]
    df = S.substring_dedup(docs_of(rows), keep_text=True)
    assert got(df) == brute_force(rows, 20)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in df.collect())
    assert got(S.substring_dedup(docs_of([]))) == []


def test_rows_that_share_an_id(docs_of):
    passage = " ".join(f"p{k}" for k in range(30))
    rows = S.substring_dedup(docs_of([(1, passage + " a"), (1, passage + " b"), (1, passage + " b"), (2, passage)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) in ([(1, 0), (1, 30), (1, 30), (2, 30)], [(1, 0), (1, 0), (1, 30), (2, 30)])


def test_hashes_roll():
    import numpy as np
    x = np.random.default_rng(1).integers(0, 1 << 63, 100).astype(np.uint64)
    for size in (1, 2, 3, 5, 7, 16, 20):
        r = S.rolling(x, size)
        assert len(r) == 101 - size and all(r[k] == S.rolling(x[k:k + size], size)[0] for k in (0, 13, 100 - size))
        assert (S.sliding_min(x, size) == [x[k:k + size].min() for k in range(101 - size)]).all()
