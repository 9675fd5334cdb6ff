"""BPE encoding and decoding with a contiguous rank array.

A word's parts lie in one array and the rank of each neighbouring pair in another. The lowest rank is found by scanning, its
boundary is deleted and the two ranks beside it are looked up again. For words of a few letters this beats a heap.
Long runs (a text may be one word) take the same merges from a heap, as scanning them costs the square of their length.

Encodes as the tokenizers library does with a lower-casing word BPE: special strings first, then NFC, white space, lower case,
words by pattern, bytes, merges with an end-of-word mark. Decoding joins the tokens' own texts with spaces, as that
library does for a file without a decoder. The decoded text is made from the ids.
"""

from __future__ import annotations

import hashlib
import heapq
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.rows import map_batches
from tidemark.llm.vocab import CACHE_CHARS, CACHE_WORDS, Vocab, load, special_pattern

NONE = 1 << 40
#: Words of more bytes are merged from a heap.
SHORT = 64
#: Fixed by the tokenizer's file: contractions, runs of letters, single digits, runs of other signs.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def merge_short(parts: list[int], vocab: Vocab) -> list[int]:
    """Merges in place, by the rank array."""
    look, merged = vocab.merges.get, vocab.merged
    ranks = [look(pair, NONE) for pair in zip(parts, parts[1:])]
    while ranks:
        low = min(ranks)
        if low == NONE:
            break
        i = ranks.index(low)
        parts[i] = merged[low]
        del parts[i + 1], ranks[i]
        if i:
            ranks[i - 1] = look((parts[i - 1], parts[i]), NONE)
        if i < len(ranks):
            ranks[i] = look((parts[i], parts[i + 1]), NONE)
    return parts


def merge_long(parts: list[int], vocab: Vocab) -> list[int]:
    """The same merges from a heap of (rank, place) over a linked list."""
    look, merged, n = vocab.merges.get, vocab.merged, len(parts)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i) for i, r in enumerate(look(p, NONE) for p in zip(parts, parts[1:])) if r != NONE]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or look((parts[i], parts[j]), NONE) != rank:
            continue
        parts[i], alive[j] = merged[rank], False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < n and (r := look((parts[a], parts[after[a]]), NONE)) != NONE:
                heapq.heappush(heap, (r, a))
    return [p for p, keep in zip(parts, alive, strict=True) if keep]


def merge(raw: bytes, vocab: Vocab) -> list[int]:
    parts = [vocab.first[b] for b in raw]
    if parts:
        parts[-1] = vocab.last[raw[-1]]
    return (merge_short if len(parts) <= SHORT else merge_long)(parts, vocab)


#: Capitals of newer editions of Unicode, and their small letters.
CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
CAPITALS |= {c: c + 32 for c in range(0x10D50, 0x10D66)} | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}
NEWER = regex.compile("[" + "".join(map(chr, CAPITALS)) + "]")


def normalise(text: str) -> str:
    # Lower case letter by letter: at the end of a word, too, sigma stays what it is alone.
    text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    return text if text.isascii() or not NEWER.search(text) else text.translate(CAPITALS)


class Words(dict):
    """A word to its ids as little-endian bytes."""

    def __init__(self, vocab: Vocab):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, word: str) -> bytes:
        found = array("I", merge(word.encode("utf-8"), self.vocab)).tobytes()
        if len(self) < CACHE_WORDS and len(word) <= CACHE_CHARS:
            self[word] = found
        return found


@lru_cache(4)
def words_of(path: str) -> Words:
    return Words(load(path))


def _ids(text: str, path: str) -> bytes:
    """The ids of a whole text as little-endian bytes."""
    words, split = words_of(path), special_pattern(path)
    pieces = split.split(text) if split else [text]
    if len(pieces) == 1:
        return b"".join(map(words.__getitem__, WORDS.findall(normalise(text))))
    out: list[bytes] = []
    for k, piece in enumerate(pieces):
        out += [array("I", [words.vocab.special[piece]]).tobytes()] if k % 2 else map(words.__getitem__, WORDS.findall(normalise(piece)))
    return b"".join(out)


def encode(text: str | None, path: str) -> list[int]:
    """Token ids of a whole text; a null text has none."""
    return array("I", _ids(text or "", path)).tolist()


def decode(ids: list[int], path: str) -> str:
    """The text of the ids, special ones included; unknown ids are left out."""
    texts = load(path).texts
    try:
        return " ".join(map(texts.__getitem__, ids))
    except KeyError:
        return " ".join([texts[i] for i in ids if i in texts])


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) for each row: token ids and the text that they decode to.

    Null and empty texts have no ids and decode to the empty text. Repeated rows are returned as often as they come,
    null ids too. Other columns are not read; an empty table gives an empty result.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, decoded = [], []
        for text in batch.column(1).to_pylist():
            ids.append(np.frombuffer(_ids(text or "", path), "<u4").astype(np.int32))
            decoded.append(decode(ids[-1].tolist(), path))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=["id", "ids", "decoded"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), work, "id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for each row, with the rules of encode_documents."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, a, b = [], [], []
        for text in batch.column(1).to_pylist():
            raw = _ids(text or "", path)
            n.append(len(raw) // 4)
            a.append(hashlib.sha256(raw).hexdigest())
            b.append(hashlib.sha256(decode(array("I", raw), path).encode("utf-8")).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), work, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
