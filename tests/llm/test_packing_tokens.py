import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from claimspark.llm import packing, token_files
from claimspark.llm.catalog import op1_best_fit_packing, op10_token_files, tokenizer_path
from claimspark.llm.tokens import Encoder, Room, encode_in_slices


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


EDGE = ["", " ", "  ", "a  b", " a", "a ", "a\nb", "a\n\nb", "\n a", "a \n b", "\t x\ty", "it's we'll 'S", "a  b", "x  y",
        "<|endoftext|> hi<|endoftext|>", "é è\n", "a   b    c", "日本 語", "a\x1c b", "\u0085 a \u0085", "🙂 🙂\n🙂", "a​ b", "1 2 3\r\n4"]


def test_chunks_equal_whole_texts(spark, sf_small, library):
    texts = EDGE + [r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    small = Encoder(tokenizer_path(), limit=50)  # forgets between calls
    for enc in (Encoder(tokenizer_path()), small):
        got = [x for at in range(0, len(texts), 7) for x in enc.encode(texts[at:at + 7])]
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ids_of(library, t) for t in texts]


def test_special_tokens():
    """The library's own ids by default; ordinary text where asked for."""
    text = "hello <|endoftext|> world"
    ids = {o: np.frombuffer(Encoder(tokenizer_path(), ordinary=o).encode([text, "x"])[0], "<u4").tolist() for o in (False, True)}
    assert ids[False] == [31373, 220, 50256, 995] and 50256 not in ids[True] and len(ids[True]) == 9


def test_slices_do_not_matter(library):
    """Borders of slices, and a text longer than a slice."""
    texts = [None, "a b", "", "long one " * 300, "<|endoftext|>", *EDGE, "end"] * 3
    want = [ids_of(library, t) for t in texts]
    for room in (Room(1, 2), Room(50, 5), Room(10_000, 10)):
        got = dict(encode_in_slices(tokenizer_path(), texts, room))
        assert [np.frombuffer(got[k], "<u4").tolist() for k in range(len(texts))] == want


def best_fit_decreasing(lengths, capacity):
    """The textbook loop: every piece to the tightest open sequence."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 64, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.choice([0, 1, 40, 400]))]
    runs = packing.plan(Counter(lengths), capacity)
    fill, seen = defaultdict(int), Counter()
    for length, n in Counter(lengths).items():
        mine = sorted((r, f, e, o) for L, r, f, e, o in zip(*(runs[c].tolist() for c in ("length", "rank", "first", "each", "offset"))) if L == length)
        for rank in range(n):
            r, f, e, o = [x for x in mine if x[0] <= rank][-1]
            fill[f + (rank - r) // e] += length
            seen[length] += 1
    assert seen == Counter(lengths)
    assert sorted(capacity - x for x in fill.values()) == best_fit_decreasing(lengths, capacity)
    assert len(runs["rank"]) <= 252 * capacity


def check_packed(rows, expected, capacity):
    """Every id of every document stands once, and sequences have no gaps."""
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for spans in by_seq.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= capacity
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = Counter()
    for doc_id, ids in expected:
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert got == want
    return len(by_seq)


def test_pack_edge_rows(spark, docs_of, nasty, library):
    expected = [(d, ids_of(library, t) + [0]) for d, t in nasty]
    packed = packing.pack(docs_of(nasty), tokenizer_path(), capacity=256, keep_ids=True).cache()
    rows = packed.collect()
    n = check_packed(rows, expected, 256)
    lengths = [r.length for r in rows]
    assert n == len(best_fit_decreasing(lengths, 256))
    whole = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(lengths) and all(len(r.ids) <= 4 * 256 for r in whole)
    assert packing.pack(docs_of([]), tokenizer_path()).count() == 0


def test_pack_query(spark, sf_small, library):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").collect()
    rows = op1_best_fit_packing(spark, sf_small).collect()
    n = check_packed(rows, [(d.doc_id, ids_of(library, d.text) + [0]) for d in docs], 2048)
    assert n <= 1.02 * -(-sum(r.length for r in rows) // 2048) + 1


def check_files(rows, docs, library):
    at = 0
    for r, (doc_id, text) in zip(rows, docs, strict=True):
        ids = ids_of(library, text) + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_files_query(spark, sf_small, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").orderBy("doc_id").collect()]
    check_files(sorted(op10_token_files(spark, sf_small).collect(), key=lambda r: r.start), docs, library)


@pytest.mark.parametrize("wide", [False, True])
def test_token_files_edge_rows(spark, docs_of, nasty, library, wide):
    manifest = token_files.write_tokens(docs_of(nasty), tokenizer_path(), length=64, wide=wide)
    rows = sorted(token_files.read_tokens(manifest).collect(), key=lambda r: r.start)
    check_files(rows, sorted(nasty, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")), library)
    assert token_files.read_tokens(token_files.write_tokens(docs_of([]), tokenizer_path())).count() == 0


def test_sequences_are_views_with_masks(spark, docs_of, library):
    manifest = token_files.write_tokens(docs_of([(1, "a b c d e f g " * 40)]), tokenizer_path(), length=64)
    row = manifest.first()
    reader = token_files.SequenceReader(row.file)
    want, got = ids_of(library, "a b c d e f g " * 40) + [2], []
    for k in range(-(-row.n_tokens // 64)):
        ids, mask = reader.sequence(k)
        assert len(ids) == len(mask) == 64 and not ids.flags.owndata
        got += ids[mask].tolist()
    assert got == want
