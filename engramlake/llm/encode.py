"""Token ids of whole texts by a public byte-level BPE vocabulary.

Merging uses a hierarchical-bitmap rank queue: every merge rank has a bucket of
linked-list positions, three levels of bitmaps say which buckets are filled, and
find-first-set names the next rank.  A pair is pushed when it arises; an entry whose
neighbours have changed since is stale and skipped when its bucket is drained.  Cost is
linear in the length of a pre-token, with no heap, so a pre-token of megabytes is no
special case.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from engramlake.runtime import spread

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
_WORD = 6  # a bitmap word covers 64 entries
_FULL = 1 << _WORD
#: Pre-tokens longer than this are encoded but not remembered.
_MEMO_CHARS = 48
_MEMO_SIZE = 400_000
_READY: dict[str, "BytePairEncoder"] = {}


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file, reversed."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class BytePairEncoder:
    """Encoder for one vocabulary file (``tokenizers`` JSON of a byte-level BPE)."""

    def __init__(self, vocabulary: bytes):
        import regex

        model = json.loads(vocabulary)["model"]
        ids, letters = model["vocab"], _byte_letters()
        self.byte_id = [0] * 256
        for letter, byte in letters.items():
            self.byte_id[byte] = ids[letter]
        self.rank: dict[int, int] = {}
        self.left, self.right, self.made = [], [], []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[ids[a] << 24 | ids[b]] = rank
            self.left.append(ids[a])
            self.right.append(ids[b])
            self.made.append(ids[a + b])
        words = (len(self.made) >> _WORD) + 1
        self._low = [0] * words
        self._mid = [0] * ((words >> _WORD) + 1)
        self._top = 0
        self._split = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
            r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
        ).findall
        self._memo: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids of ``text``; an empty list for an empty or null text."""
        if not text:
            return []
        memo, out = self._memo, []
        for piece in self._split(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.merge([self.byte_id[b] for b in piece.encode("utf-8", "replace")])
                if len(piece) <= _MEMO_CHARS:
                    if len(memo) >= _MEMO_SIZE:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merges to the byte ids of one pre-token."""
        n = len(ids)
        if n < 2:
            return ids
        rank, low, mid = self.rank, self._low, self._mid
        left, right, made = self.left, self.right, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        buckets: dict[int, list[int]] = {}
        top = self._top

        for i in range(n - 1):
            r = rank.get(ids[i] << 24 | ids[i + 1])
            if r is not None:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    w = r >> _WORD
                    low[w] |= 1 << (r & 63)
                    mid[w >> _WORD] |= 1 << (w & 63)
                    top |= 1 << (w >> _WORD)
        while top:
            m = (top & -top).bit_length() - 1
            word = mid[m]
            w = m << _WORD | (word & -word).bit_length() - 1
            word = low[w]
            bit = word & -word
            r = w << _WORD | bit.bit_length() - 1
            low[w] = word ^ bit
            if not low[w]:
                mid[m] ^= 1 << (w & 63)
                if not mid[m]:
                    top ^= 1 << m
            a, b, new = left[r], right[r], made[r]
            for i in sorted(buckets.pop(r)):
                j = after[i]
                if ids[i] != a or j >= n or ids[j] != b:
                    continue  # stale
                ids[i], ids[j] = new, -1
                k = after[i] = after[j]
                for p, q in ((before[i], i), (i, k)):
                    if p >= 0 and q < n:
                        fresh = rank.get(ids[p] << 24 | ids[q])
                        if fresh is not None:
                            if fresh in buckets:
                                buckets[fresh].append(p)
                            else:
                                buckets[fresh] = [p]
                                v = fresh >> _WORD
                                low[v] |= 1 << (fresh & 63)
                                mid[v >> _WORD] |= 1 << (v & 63)
                                top |= 1 << (v >> _WORD)
                if k < n:
                    before[k] = i
        return [x for x in ids if x >= 0]


def _encoder(vocabulary: bytes, digest: str) -> BytePairEncoder:
    if digest not in _READY:
        _READY[digest] = BytePairEncoder(vocabulary)
    return _READY[digest]


def encode_corpus(docs: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(key, ids array<int>)`` for every row of ``docs``; one pass, no shuffle.

    Null and empty texts give an empty list; a null key and repeated rows are kept as
    they are; other columns are not read.  The vocabulary (a file of fixed size, about
    1.5 MB) is read by the driver and broadcast, so executors need no copy of it.  Special
    tokens' strings in a text count as ordinary text.  Lone surrogates, which no valid
    UTF-8 text holds, would become ``?``.
    """
    raw = open(vocabulary, "rb").read()
    digest = hashlib.sha256(raw).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(raw)
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(shared.value, digest).encode
        for batch in batches:
            offsets, flat = [0], []
            for t in batch.column(1).to_pylist():
                flat += encode(t)
                offsets.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return spread(docs.select(key, text), key).mapInArrow(run, schema)
