import hashlib
import re
from collections import defaultdict

import pytest

from claimspark.llm.exact_dedup import exact_dedup


def brute_force(rows):
    groups = defaultdict(list)
    for k, (doc_id, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, k))
    out = []
    for norm, members in groups.items():
        best = min(members)
        for m in members:
            out.append((rows[m[3]][0], rows[best[3]][0], len(members), m == best, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_edge_rows(docs_of, nasty):
    rows = nasty + [(-5, " a b c"), (-(1 << 63), "far"), ((1 << 63) - 1, "f a r"), (None, "fa r"), (None, "only"), (None, "only"),
                    (20, "a b"), (21, "ab"), (22, "🙂 x"), (23, "🙂x ")]
    assert got(exact_dedup(docs_of(rows))) == brute_force(rows)


def test_one_text_holds_most_rows(docs_of):
    rows = [(k, "same text " + " " * (k % 7)) for k in range(500)] + [(1000 + k, f"t{k % 40}") for k in range(100)]
    assert got(exact_dedup(docs_of(rows))) == brute_force(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, None), (None, "")]])
def test_tiny(docs_of, rows):
    assert got(exact_dedup(docs_of(rows))) == brute_force(rows)
