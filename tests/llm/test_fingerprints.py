"""Document fingerprints: edits against brute force, and what trees of near texts share."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from claimspark.llm import fingerprints as fp


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def tree(text):
    pieces = re.findall(fp.LEAF, text)
    assert "".join(pieces) == text
    marked = [f"{sha(p)}.{len(p)}{'/' if p.endswith(chr(10)) else '-'}" for p in pieces]
    paragraphs = [sha(x) for x in "".join(marked).split("/") if x]
    sections = [sha(x) for x in "".join(p + ("|" if p < "4" else "-") for p in paragraphs).split("|") if x]
    return sha("".join(sections)), [s[:fp.DIGITS] for s in sections], [(int(m[:8], 16) >> 32 - fp.LEAF_BITS) * 64 + int(m[65:-1]) for m in marked]


def points(leaves):
    return sum(x % 64 for x in leaves)


def written(t):
    return ";".join([t[0], ",".join(t[1]), ",".join(f"{x:x}" for x in t[2])])


def near(a, b):
    both = points(set(a[2])) + points(set(b[2]))
    return 1.0 if a[0] == b[0] else round(2 * points(set(a[2]) & set(b[2])) / both, 9) if both else 0.0


def ends(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return points(a[:n])


def brute_force(rows):
    rows = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, sha(f"{'-' if r[0] is None else r[0]}:{r[1]}")))
    out = []
    for k, (doc_id, text) in enumerate(rows):
        follow, n = rows[(k + 1) % len(rows)][1], len(text)
        edited = text[:n - n // 4] + follow[:n // 4]
        a, b, c = tree(text), tree(edited), tree(follow)
        front = ends(a[2], b[2])
        out.append((doc_id, n, sha(edited), written(a), written(b), near(a, b), near(a, c),
                    len(a[1]), len(set(b[1]) - set(a[1])), front, n - min(ends(a[2][::-1], b[2][::-1]), n - front)))
    return Counter(out)


def got(df):
    return Counter(tuple(r) for r in fp.edits(df).collect())


LINES = "".join(f"Line {k} of a text, which is long enough; is it?\n" for k in range(60))
ODD = [(60, LINES), (61, LINES.replace("Line 30", "Row 30")), (62, LINES), (63, "Inserted.\n" + LINES), (70, "no end " * 40), (71, "\n\n\n"), (72, "..!?"), (73, "é🙂" * 90), (74, "a\rb\x00c")]


def test_odd_rows(docs_of, nasty):
    rows = nasty + ODD
    assert got(docs_of(rows)) == brute_force(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "a b"), (None, "a b")], [(1, "only one. " * 9)]])
def test_tiny(docs_of, rows):
    assert got(docs_of(rows)) == brute_force(rows)


def test_many_copies_of_a_row(docs_of):
    rows = [(5, "the same text, again")] * 700 + [(k, f"text {k}. " * 5) for k in range(9)]
    assert got(docs_of(rows)) == brute_force(rows)


def test_one_changed_word_changes_one_branch(spark, docs_of):
    by_id = {r.doc_id: r for r in fp.with_tree(fp._key(docs_of(ODD)), "text", "tree").collect()}
    same, other, more = (by_id[k].tree for k in (60, 61, 63))
    assert same.root == by_id[62].tree.root != other.root
    assert len(set(other.sections) - set(same.sections)) == 1 < len(same.sections)
    # an insertion at the beginning moves the border of the first section only
    assert len(set(more.sections) - set(same.sections)) <= 2


def test_leaf_pattern_covers_every_text(spark):
    texts = ["", "a", "." * 200, "x" * 500, "\n", "a.b,c;d:e!f?g\nh", "日本。" * 30]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.array_join(F.regexp_extract_all("text", F.lit(fp.LEAF), F.lit(0)), "").alias("all"))
    assert all(r.text == r["all"] for r in df.collect())
