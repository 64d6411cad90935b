"""Which chunks the encoder takes from a text, what it remembers, and what a worker holds."""

import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from claimspark.llm import packing, token_files
from claimspark.llm.catalog import tokenizer_path
from claimspark.llm.tokens import NARROW, WIDE, Encoder, Room, encode_in_slices

BITS = ["a", "Word", "'s", "'ll", "'", "''", ".", ",", "%%%", "***", "12", "7", "é", "ß", "ü", "日本", "🙂", "€", "ª", "²", "́", "ɐ", "_", "-", '"', "x" * 300]


def plain_ids(enc, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)]


def test_random_mixtures_equal_the_library():
    """Letters, digits, marks, apostrophes and characters beyond ASCII side by side, with single and other white space."""
    rng = random.Random(3)
    texts = ["".join(rng.choice(BITS) + rng.choice(["", "", " ", "\n"] if k % 5 else ["", " ", "  ", "\n\n", "\t"]) for _ in range(rng.randint(1, 30))) for k in range(3000)]
    library = Tokenizer.from_file(tokenizer_path())
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for limit in (4, 1_000_000):
        enc = Encoder(tokenizer_path(), limit=limit)
        assert [x for at in range(0, len(texts), 70) for x in plain_ids(enc, texts[at:at + 70])] == want


def test_words_are_told_from_the_marks_around_them():
    """One word is one chunk, whatever marks follow it, and its ids are found once."""
    enc = Encoder(tokenizer_path())
    whole, asked = enc._whole, []
    enc._whole = lambda texts: asked.extend(texts) or whole(texts)
    enc.encode(["thoninti thoninti. thoninti%%% (thoninti) thoninti123 thoninti###", "größe thoninti"])
    assert sum("thoninti" in x for x in asked) == 0 and len(asked) <= 8


def test_frequent_chunks_are_remembered():
    """Chunks met again and again outlast the many that are met once; what is remembered stays bounded."""
    enc = Encoder(tokenizer_path(), limit=100)
    found, asked = enc._word, []
    enc._word = lambda chunk: asked.append(chunk) or found(chunk)
    letters = "abcdefghij"
    for k in range(60):
        enc.encode(["common " * 3 + "again " + " ".join("z" + "".join(letters[int(d)] for d in str(40 * k + j)) for j in range(40)) + " common"])
        assert len(enc.recent) + len(enc.older) <= 2 * (50 + 50)
    assert asked.count(b" common") == 1 and asked.count(b" again") == 1


def test_a_file_with_another_cut_is_not_chunked(tmp_path):
    """Where the file cuts texts otherwise, they go to the library whole."""
    from tokenizers import pre_tokenizers

    library = Tokenizer.from_file(tokenizer_path())
    library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True, use_regex=False)
    library.save(str(tmp_path / "t.json"))
    texts = ["of the, and of the. 12", "a b\nc"]
    assert plain_ids(Encoder(str(tmp_path / "t.json")), texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_a_worker_holds_little():
    """Over 24 MB of words that are nearly all new, the narrow room adds less than 110 MB to a worker."""
    code = """
import random, resource
import pyarrow as pa
from claimspark.llm.catalog import tokenizer_path
from claimspark.llm.tokens import NARROW, encode_in_slices
rng = random.Random(1)
parts = ["th", "an", "er", "on", "in", "re", "ed", "nd", "ha", "at", "en", "es", "of", "or"]
texts = pa.array([" ".join("".join(rng.choices(parts, k=rng.randint(2, 7))) for _ in range(300)) for _ in range(8000)])
list(encode_in_slices(tokenizer_path(), pa.array(["x"]), NARROW))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert sum(len(ids) for _, ids in encode_in_slices(tokenizer_path(), texts, NARROW)) > 0
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr
    assert float(run.stdout) < 110


def test_slices_of_arrow_columns():
    """A column with nulls, also one that starts in the middle of its buffers."""
    texts = [None, "a b", "", "long one " * 30, "%%%", None, "end."]
    want = Encoder(tokenizer_path()).encode([t or "" for t in texts])
    for room in (Room(1, 2), Room(40, 5), WIDE):
        for kind in (pa.string(), pa.large_string()):
            column = pa.array(["skipped", *texts], kind)[1:]
            assert [x for _, x in encode_in_slices(tokenizer_path(), column, room)] == want
    assert list(encode_in_slices(tokenizer_path(), pa.array([], pa.string()))) == []


def test_spark_hands_over_a_slice_at_a_time(spark, docs_of, monkeypatch):
    """The jobs that tokenize take batches of the room's size; the session's own setting holds again afterwards."""
    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(key)
    for module in (packing, token_files):
        write = module.write_shared
        monkeypatch.setattr(module, "write_shared", lambda df, what, write=write: seen.append((what, spark.conf.get(key))) or write(df, what))
    docs = docs_of([(1, "a b"), (2, None)])
    packing.pack(docs, tokenizer_path(), room=NARROW)
    packing.pack(docs, tokenizer_path())
    token_files.write_tokens(docs, tokenizer_path())
    assert seen == [("pieces", f"{NARROW.chars}b"), ("pieces", f"{WIDE.chars}b"), ("manifest", f"{WIDE.chars}b")]
    assert spark.conf.get(key) == before
