"""Benchmark decontamination by size-partitioned MinHash containment search, verified on exact shingles.

A test item is a small set of shingles, a document a large one, so the similarity of the two sets is near zero even where the item
lies whole in the document. The search is therefore partitioned by size: items of more than u/2 and at most u
shingles (u a power of two) form a partition, and for it documents are cut into windows of 2u shingles at
steps of u, so every stretch of u shingles lies whole in a window. An item whose share of at least THRESHOLD lies in a window then
has a similarity of about a fifth or more with it, and with PERMUTATIONS minima each their own band, the chance to
miss it is (1 - 0.19) ** PERMUTATIONS, about one in 10,000 at 44; an item that lies whole in a window, one in 1,000,000.
Minima of larger windows come from those of smaller ones, so each shingle is hashed once.

Every item found for a document is then held to the share of its shingles that the whole document has, word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.rows import pieces, prepare

SHINGLE = 5
THRESHOLD = 0.8
PERMUTATIONS = 44
#: Items that are broadcast at a time; more are searched in blocks, a pass over the documents each.
BLOCK_ITEMS = 20_000
#: Words of a document that are hashed at a time, besides the overlap.
CHUNK = 1 << 16
#: ASCII signs separate words; what else is a letter is lower-cased before.
WORD_TABLE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_rng = np.random.default_rng(20)
MULTIPLY = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
STEP, FINAL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


def shingles_of(words: list[bytes], width: int = SHINGLE) -> set[bytes]:
    """Distinct shingles; fewer words than the width are one shingle, no word is none."""
    if len(words) <= width:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_digest
    return np.frombuffer(b"".join([digest(w) for w in words]), ">u8").astype(np.uint64)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for k in range(1, width):
        h = (h * STEP) ^ (h >> np.uint64(29)) ^ words[k : n + k]
    h = (h ^ (h >> np.uint64(32))) * FINAL
    return h ^ (h >> np.uint64(31))


class Partition(NamedTuple):
    """Items of one shingle width and size class."""

    width: int
    size: int
    keys: list[np.ndarray]  # by permutation: the items' minima, sorted
    items: list[np.ndarray]  # and whose each is


class Index(NamedTuple):
    partitions: list[Partition]
    shingles: list[set[bytes]]  # of each item
    ids: list


def build(items: list[tuple]) -> Index:
    """An index of (id, text) pairs. Items without a word are in none; a null id is kept."""
    found = [(key, words_of(text)) for key, text in items]
    found = [(key, words) for key, words in found if words]
    groups: dict[tuple[int, int], list[int]] = {}
    sets = []
    for k, (_, words) in enumerate(found):
        width = min(SHINGLE, len(words))
        sets.append(shingles_of(words))
        size = 1 << (len(sets[-1]) - 1).bit_length()
        groups.setdefault((width, size), []).append(k)
    partitions = []
    for (width, size), own in sorted(groups.items()):
        minima = np.stack([((shingle_hashes(word_hashes(found[k][1]), width)[:, None] * MULTIPLY + ADD)).min(axis=0) for k in own])
        order = [np.argsort(minima[:, p], kind="stable") for p in range(PERMUTATIONS)]
        partitions.append(Partition(width, size, [minima[o, p] for p, o in enumerate(order)], [np.array(own)[o] for o in order]))
    return Index(partitions, sets, [key for key, _ in found])


def _window_minima(hashes: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(size, permutation, minima of the windows) for each size of the list, ascending."""
    for p in range(PERMUTATIONS):
        values = hashes * MULTIPLY[p] + ADD[p]
        block, size = values, 1
        for wanted in sizes:
            if size < wanted:
                block = np.minimum.reduceat(block, np.arange(0, len(block), wanted // size))
                size = wanted
            yield size, p, np.minimum(block[:-1], block[1:]) if len(block) > 1 else block


def candidates(index: Index, docs: list[list[bytes]]) -> list[set[int]]:
    """For each document's words, the items that share a minimum with one of its windows.

    Documents are laid end to end, so windows cost the same for short ones; a window over a cut counts for both sides.
    """
    out: list[set[int]] = [set() for _ in docs]
    ends = np.cumsum([len(x) for x in docs])
    if not index.partitions or not len(ends) or not ends[-1]:
        return out
    hashed = np.concatenate([word_hashes(x) for x in docs if x])
    by_width: dict[int, dict[int, Partition]] = {}
    for part in index.partitions:
        by_width.setdefault(part.width, {})[part.size] = part
    longest = max(part.size for part in index.partitions)
    step = max(CHUNK // (2 * longest), 1) * 2 * longest
    for at in range(0, len(hashed), step):
        # Chunks overlap by two windows, so no window across the cut is lost.
        own = hashed[at : at + step + 2 * longest + SHINGLE]
        for width, parts in by_width.items():
            h = shingle_hashes(own, width)
            for size, p, minima in _window_minima(h, sorted(parts)) if len(h) else ():
                keys = parts[size].keys[p]
                where = np.searchsorted(keys, minima)
                where[where == len(keys)] = 0
                for k in np.flatnonzero(keys[where] == minima):
                    first = int(np.searchsorted(ends, at + k * size, "right"))
                    last = int(np.searchsorted(ends, min(at + (k + 2) * size + width, ends[-1]) - 1, "right"))
                    a, b = where[k], np.searchsorted(keys, minima[k], "right")
                    for d in range(first, last + 1):
                        out[d].update(parts[size].items[p][a:b].tolist())
    return out


def contained(index: Index, texts: list[str | None], threshold: float = THRESHOLD) -> list[list[tuple]]:
    """For each text (item id, containment) of the items whose share of shingles in it reaches the threshold."""
    out: list[list[tuple]] = []
    group: list[list[bytes]] = []
    size = 0

    def flush() -> None:
        for words, found in zip(group, candidates(index, group), strict=True):
            out.append(verified(index, words, found, threshold))
        group.clear()

    for text in texts:
        group.append(words_of(text))
        size += len(group[-1])
        if size >= CHUNK:
            flush()
            size = 0
    flush()
    return out


def verified(index: Index, words: list[bytes], found: set[int], threshold: float) -> list[tuple]:
    whole: dict[int, set[bytes]] = {}
    out = []
    for k in sorted(found):
        own = index.shingles[k]
        width = next(iter(own)).count(b" ") + 1
        if width not in whole:
            whole[width] = {b" ".join(x) for x in zip(*[words[i:] for i in range(width)], strict=False)}
        share = len(own & whole[width]) / len(own)
        if share >= threshold - 1e-12:
            out.append((index.ids[k], share))
    return out


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = BLOCK_ITEMS) -> Iterator[list[tuple]]:
    """Distinct items in blocks of about `size`, dealt by a hash. Equal ids with different texts are items of their own."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    n = pieces(items.count(), size)
    for k in range(n):
        yield [(r["item"], r["text"]) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).orderBy("item", "text").toLocalIterator()]


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, containment) for each document and each item of which it has the threshold's share of shingles.

    Words are runs of letters and digits in lower case; shingles have five words, an item of fewer is one shingle.
    Null and empty texts on either side match nothing. Repeated rows give repeated matches; an id with a null is kept as
    null; other columns are not read; empty tables give an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = []
    for block in item_blocks(benchmark, item_col, item_text_col):
        held = spark.sparkContext.broadcast(build([(None if k is None else int(k), t) for k, t in block]))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = contained(held.value, batch.column(1).to_pylist(), threshold)
                out = [(key, item, share) for key, own in zip(batch.column(0).to_pylist(), found, strict=True) for item, share in own]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["id", "item", "containment"])

        parts.append(rows.mapInArrow(run, "id long, item long, containment double"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that no item is contained in."""
    spark = docs.sparkSession
    prepare(spark)
    at = docs.columns.index(text_col)
    out = docs
    for block in item_blocks(benchmark, item_col, item_text_col):
        held = spark.sparkContext.broadcast(build([(None if k is None else int(k), t) for k, t in block]))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not x for x in contained(held.value, batch.column(at).to_pylist(), threshold)], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
