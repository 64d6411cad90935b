"""Token ids of whole texts by a public tokenizer file, with a memory of chunks.

A byte-level BPE cuts a text by a fixed expression and never merges across its
borders: before a single space that stands between visible characters, around a
single line feed there, and between ASCII letters, digits and punctuation. So
the ids of a text are the ids of its chunks put together. Each distinct chunk
of a slice goes to the tokenizers library, unless the worker remembers it: a
word or number to its BPE model alone, as nothing is left to cut, any other
chunk to the whole tokenizer. Texts with other white space or control
characters go there whole. ``tests/llm`` compares the ids with the library's.
"""

from __future__ import annotations

import json
import os
import string
import struct
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

from ..session import settings
from .common import MEMORIES, hold

OTHER, LETTER, DIGIT, MARK, APOSTROPHE, SPACE, FEED = range(7)
#: Kind of each byte; bytes of characters beyond ASCII are OTHER.
KINDS = bytes(FEED if c == "\n" else SPACE if c == " " else APOSTROPHE if c == "'" else LETTER if c in string.ascii_letters
              else DIGIT if c in string.digits else MARK if c in string.punctuation else OTHER for c in map(chr, range(256)))


def _apart(a: int, b: int) -> bool:
    """A chunk ends between bytes of these kinds. An apostrophe may belong to the letters after it ('ll) or to the marks before it."""
    return b in (SPACE, FEED) or a == FEED or (a in (LETTER, DIGIT, MARK) and b != OTHER and a != b and (a, b) != (MARK, APOSTROPHE))


#: By 7 * kind + next kind.
BORDERS = bytes(k < 49 and _apart(*divmod(k, 7)) for k in range(256))
#: A byte as the character that stands for it in the vocabulary of a byte-level BPE.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
CHARACTERS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


class Room(NamedTuple):
    """What a worker may hold at once: bytes of a slice of texts, chunks remembered. It changes no id."""
    chars: int
    chunks: int


#: For jobs that only tokenize, and for workers that share their executor with other stages.
WIDE, NARROW = Room(8_000_000, 1_000_000), Room(1_000_000, 100_000)


class Encoder:
    """Encodes texts into little-endian unsigned 32-bit ids (bytes).

    A special token's string in a text becomes that token, as the library does
    by default; with ``ordinary`` it is text like any other. ``limit`` bounds the
    chunks remembered: those not met since half as many new ones came are
    forgotten, which changes no id.
    """

    def __init__(self, path: str, limit: int = WIDE.chunks, ordinary: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task: Spark spreads the work
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = ordinary
        self.model = self.library.model
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        cut = made.get("pre_tokenizer") or {}
        #: Chunks are known only where the file cuts texts by the usual expression, and changes nothing else in them.
        self.chunked = (cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
                        and made["model"].get("type") == "BPE" and not any(made.get(x) for x in ("normalizer", "truncation", "padding")))
        #: Texts that hold one of these go to the library whole.
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values() if not (ordinary and t.special)]
        self.limit = limit
        self.recent: dict[bytes, bytes] = {}  # chunk, with the space before it -> ids
        self.older: dict[bytes, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, chunk: bytes) -> bytes | None:
        """Ids of a chunk that is one word or number, with or without a space before it; None: the chunk may have to be cut."""
        text = chunk.decode()
        word = text[1:] if text[0] == " " else text
        if not word.isascii():
            # letters that were ones in any version of Unicode
            if not word.isalpha() or max(word) > "\u024f":
                return None
            shown = chunk.decode("latin-1").translate(CHARACTERS)
        elif word.isalpha() or word.isdigit():
            shown = text.replace(" ", CHARACTERS[32])
        else:
            return None
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of distinct chunks."""
        if len(self.recent) > self.limit // 2:
            self.older, self.recent = self.recent, {}
        found = list(map(self.recent.get, chunks))
        odd = []
        for k in [k for k, x in enumerate(found) if x is None]:
            chunk = chunks[k]
            ids = self.older.get(chunk) or self._word(chunk)
            if ids is None:
                odd.append(k)
            else:
                found[k] = self.recent[chunk] = ids
        for k, ids in zip(odd, self._whole([chunks[k].decode() for k in odd])):
            found[k] = self.recent[chunks[k]] = ids
        return found

    def _plain(self, text: str) -> bool:
        """White space is single spaces and line feeds between visible characters, and there is no special token."""
        return not any(x in text for x in self.special) and not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text) and text.replace("\n", "").isprintable()

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [k for k, t in enumerate(texts) if self.chunked and t and self._plain(t)]
        out: list = [None] * len(texts)
        whole = sorted(set(range(len(texts))) - set(plain))
        for k, ids in zip(whole, self._whole([texts[k] for k in whole])):
            out[k] = ids
        if plain:
            rows = pa.array([texts[k] for k in plain], pa.large_string())
            _, offsets, data = rows.buffers()
            at = np.frombuffer(offsets, np.int64, len(plain) + 1)
            kinds = np.frombuffer(data, np.uint8, at[-1]).tobytes().translate(KINDS)
            pairs = np.frombuffer(kinds, np.uint8)
            border = np.ones(at[-1] + 1, bool)
            border[1:-1] = np.frombuffer((7 * pairs[:-1] + pairs[1:]).tobytes().translate(BORDERS), bool)
            border[at] = True
            edges = np.flatnonzero(border)
            chunks = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), data]).dictionary_encode()
            ids = self._ids(chunks.dictionary.to_pylist())
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            values, index = np.frombuffer(b"".join(ids), "<u4"), chunks.indices.to_numpy()
            n = sizes[index]
            ends = np.concatenate([[0], np.cumsum(n)])
            place = np.repeat((np.cumsum(sizes) - sizes)[index] - ends[:-1], n) + np.arange(ends[-1])
            data = values[place].tobytes()
            bounds = (4 * ends[np.searchsorted(edges, at)]).tolist()
            for k, a, b in zip(plain, bounds, bounds[1:]):
                out[k] = data[a:b]
        return out


_ENCODERS: dict[tuple[str, bool], Encoder] = MEMORIES.setdefault("tokens", {})


def encoder(path: str, ordinary: bool = False) -> Encoder:
    """One encoder per Python worker and tokenizer file."""
    if (path, ordinary) not in _ENCODERS:
        _ENCODERS[path, ordinary] = Encoder(path, ordinary=ordinary)
    return _ENCODERS[path, ordinary]


def encode_in_slices(path: str, texts: list | pa.Array, room: Room = WIDE, ordinary: bool = False):
    """Yield (position, ids) of each text (null: empty), about ``room.chars`` bytes of text at a time, whole texts always."""
    hold("tokens")
    enc, at = encoder(path, ordinary), 0
    enc.limit = room.chunks
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    while at < len(ends):
        before = ends[at - 1] if at else 0
        end = int(np.searchsorted(ends, before + room.chars)) + 1
        for k, ids in enumerate(enc.encode([t or "" for t in column[at:end].to_pylist()])):
            yield at + k, ids
        at = end


def slices(spark: SparkSession, room: Room = WIDE):
    """For the action that tokenizes: Spark hands over a slice of texts at a time, so neither side holds thousands of long texts."""
    return settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": f"{room.chars}b"})
