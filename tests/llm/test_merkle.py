"""The Merkle manifest against a plain level-by-level tree, for several block heights."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from claimspark.llm import merkle


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row
    return digest([field(doc_id), field(source), field(lang), field(None if n_chars is None else n_chars + more), field(text)])


def tree(nodes):
    """Root, and for each node its place in its run and the run's others, level by level."""
    level, below, paths = list(nodes), [[i] for i in range(len(nodes))], [[] for _ in nodes]
    while len(level) > 1:
        runs = [range(k, min(k + 2, len(level))) for k in range(0, len(level), 2)]
        for run in runs:
            for k in run:
                for i in below[k]:
                    paths[i].append((k - run[0], [level[o] for o in run if o != k]))
        level, below = [digest([level[k] for k in run]) for run in runs], [[i for k in run for i in below[k]] for run in runs]
    return level[0], paths


def brute_force(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    members = [sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for lang in langs]
    trees = [tree([leaf(r) for r in m]) for m in members]
    root, tops = tree([t[0] for t in trees]) if trees else (None, [])
    out = []
    for m, (subroot, paths), top in zip(members, trees, tops):
        for r, path in zip(m, paths):
            changed = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = leaf(r, 1) if changed else leaf(r)
            for k, others in path + top:
                folded = digest(others[:k] + [folded] + others[k:])
            out.append((r[0], leaf(r), subroot, root, digest(x for _, others in path + top for x in others), folded, folded == root))
    return sorted(out, key=repr)


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for c in ("tree", "place", "size", "digest", "proof", "carried", "tried", "leaf", "__part", "block"):
        df = df.withColumn(c, F.lit("x"))
    return df


def run(df, levels):
    return sorted((tuple(r) for r in merkle.manifest(df, F.crc32(F.col("doc_id").cast("string")) % 7 == 0, levels).collect()), key=repr)


ODD = ([(k, f"s{k % 3}", "en" if k % 3 else "de", k, f"text {k}") for k in range(-20, 90)]
       + [(200, None, None, None, None), (None, "s", "en", 3, "no id"), (None, "s", "en", 3, "no id"), (201, "", "", 0, ""), (202, "s", "é", 5, "é🙂"),
          (203, "s", "\U0001F600", 5, "long " * 5000), (204, "s", "￿", (1 << 63) - 1, "x"), (14, "twice", "fr", 1, "a"), (14, "twice", "fr", 1, "a"), (14, "twice", "fr", 1, "b")])


@pytest.mark.parametrize("levels", [1, 2, 12])
def test_odd_rows(spark, levels):
    assert run(table(spark, ODD), levels) == brute_force(ODD)


@pytest.mark.parametrize("rows", [[], [(7, "s", None, 1, "one")], [(k, "s", "en", 1, "same") for k in range(2)], [(1, None, None, None, None)] * 5])
def test_tiny(spark, rows):
    assert run(table(spark, rows), 2) == brute_force(rows)


def test_given_rows(spark, sf_small):
    df = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    want = brute_force([tuple(r) for r in df.collect()])
    assert run(df, 3) == want
    assert not all(r[-1] for r in want) and any(r[-1] for r in want)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 64])
def test_sweeps(n):
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    levels = merkle.height(n)
    children = merkle.sweep_up(leaves, levels)
    (root,) = children[levels + 1, 0]
    assert root.hex() == tree([d.hex() for d in leaves])[0]
    proofs = dict(merkle.sweep_down(children, levels, b""))
    assert sorted(proofs) == list(range(n)) and all(merkle.fold(leaves[i], p) == root for i, p in proofs.items())


def test_labels_ascend():
    assert all(merkle.label(h + 1, i >> 1) > merkle.label(h, i) for h in range(40) for i in (0, 1, 2, 77, 1 << 20))
