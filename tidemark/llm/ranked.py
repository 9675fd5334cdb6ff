"""Ranked lexical search: the highest-scoring documents of each item, exact, by best-first branch and bound.

One pass counts the terms of every document and keeps those that an item of the block has: a forward index, stored, with the
statistics that the weights need (documents, terms, document frequencies) beside it. A second pass takes the index in shards of
documents in ascending order of id. For each term a shard holds a tree of maxima: the highest term share of any document in a range of
LEAF documents, of FAN such ranges, and so on. The bound of a range for an item is the sum of its terms' weights times their
maxima. The search opens the range with the highest bound first, scores documents only in leaves, and ends when no bound
reaches the last place; ranges whose bound equals it are opened as long as they may hold a lower id. What a task has found
for an item bounds its later shards, and the tasks' lists are merged by one ranking.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.rows import pieces, prepare, stored

#: Places of a ranking.
PLACES = 20
#: Documents of a leaf, ranges of a node, leaves and postings of a shard, and numbers of a shard's lowest level.
LEAF, FAN, LEAVES, POSTINGS, CELLS = 64, 4, 256, 1 << 21, 1 << 24
#: Distinct terms of a block of items, and terms of all its items.
BLOCK_TERMS, BLOCK_PAIRS = 1 << 16, 1 << 22
#: Bytes of a text that are split at once.
PIECE = 1 << 20
#: Letters A to Z in lower case; ASCII but letters and digits as blanks.
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def term_runs(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists; a text is cut between terms."""
    data = (text or "").encode().translate(TERMS)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def term_counts(text: str | None) -> Counter:
    out: Counter = Counter()
    for run in term_runs(text):
        out.update(run)
    return out


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


class Trees:
    """A shard: documents in ascending order of id, each with its terms and their shares, and the trees of maxima."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, terms: np.ndarray, shares: np.ndarray, n_terms: int) -> None:
        """starts: where each document's postings begin; every document has one at least."""
        self.ids, self.starts, self.terms, self.shares = ids, np.append(starts, len(terms)), terms, shares
        leaves = -(-len(ids) // LEAF)
        self.levels = [np.zeros((n_terms, leaves), np.int32)]
        leaf = np.repeat(np.arange(len(ids)) // LEAF, np.diff(self.starts))
        np.maximum.at(self.levels[0], (terms, leaf), shares)
        while self.levels[-1].shape[1] > 1:
            low = self.levels[-1]
            whole = np.zeros((n_terms, -(-low.shape[1] // FAN) * FAN), np.int32)
            whole[:, : low.shape[1]] = low
            self.levels.append(whole.reshape(n_terms, -1, FAN).max(2))

    def search(self, terms: np.ndarray, weights: np.ndarray, best: tuple[np.ndarray, np.ndarray], of_term: np.ndarray, places: int = PLACES) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the best documents, those of `best` included; of_term is all zero before and after."""
        scores, ids = best
        of_term[terms] = weights
        top = len(self.levels) - 1
        heap = [(-int(weights @ self.levels[top][terms, 0]), 0, top)]
        while heap:
            bound, node, level = heapq.heappop(heap)
            first = (node * LEAF * FAN**level) if level else node * LEAF
            if not bound or len(ids) == places and (-bound, -self.ids[first]) < (scores[-1], -ids[-1]):
                if not bound or -bound < scores[-1]:
                    break
                continue
            if level:
                low = self.levels[level - 1]
                at = np.arange(node * FAN, min(node * FAN + FAN, low.shape[1]))
                for k, b in zip(at.tolist(), (weights @ low[np.ix_(terms, at)]).tolist(), strict=True):
                    if b:
                        heapq.heappush(heap, (-b, k, level - 1))
                continue
            last = min(first + LEAF, len(self.ids))
            a, b = self.starts[first], self.starts[last]
            own = np.add.reduceat(of_term[self.terms[a:b]] * self.shares[a:b], self.starts[first:last] - a)
            hit = np.flatnonzero(own >= max(1, scores[-1] if len(ids) == places else 1))
            if len(hit):
                scores, ids = np.append(scores, own[hit]), np.append(ids, self.ids[first + hit])
                order = np.lexsort((ids, -scores))[:places]
                scores, ids = scores[order], ids[order]
        of_term[terms] = 0
        return scores, ids


def indexed(docs: DataFrame, terms: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """id, n (terms of the document), ids and counts of its terms in the block; and a row with `stats` for each task.

    Of those rows id is the number of documents that have a term, n that of their terms, and counts are document frequencies.
    """
    held = docs.sparkSession.sparkContext.broadcast(terms)
    schema = pa.schema([("stats", pa.bool_()), ("id", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = held.value.get
        frequency = np.zeros(len(held.value), np.int64)
        n_docs = n_all = 0
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, found = 0, Counter()
                for tokens in term_runs(text):
                    n += len(tokens)
                    found.update(map(get, tokens))
                found.pop(None, None)
                n_docs, n_all = n_docs + (n > 0), n_all + n
                if found:
                    ids = sorted(found)
                    frequency[ids] += 1
                    if key is not None:
                        out.append((False, key, n, ids, [found[i] for i in ids]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
        own = np.flatnonzero(frequency)
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((True, n_docs, n_all, own.tolist(), frequency[own].tolist()), schema.types, strict=True)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(run, "stats boolean, id long, n long, ids array<int>, counts array<long>"), "ranked-index")


def searched(index: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], n_terms: int, n_docs: int, n_all: int, places: int) -> DataFrame:
    """item (its number), score, id: the best of each task's documents. items: ids and weights of their terms."""
    held = index.sparkSession.sparkContext.broadcast(items)
    most = LEAF * max(1, min(LEAVES, CELLS // max(n_terms, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in held.value]
        of_term = np.zeros(n_terms, np.int64)
        shard: list[pa.RecordBatch] = []

        def walk() -> None:
            rows = pa.Table.from_batches(shard).sort_by("id").combine_chunks()
            lists, counts = (rows[c].combine_chunks() for c in ("ids", "counts"))
            sizes = np.diff(lists.offsets.to_numpy())
            tf = counts.flatten().to_numpy()
            mass = 75 + (25 * rows["n"].to_numpy() * n_docs) // n_all
            shares = (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(mass, sizes))
            tree = Trees(rows["id"].to_numpy(), np.cumsum(sizes) - sizes, lists.flatten().to_numpy(), shares.astype(np.int32), n_terms)
            for k, (terms, weights) in enumerate(held.value):
                best[k] = tree.search(terms, weights, best[k], of_term, places)
            shard.clear()

        n = postings = 0
        for batch in batches:
            # A batch is cut where a shard is full.
            ends = np.cumsum(np.diff(batch.column(2).offsets.to_numpy()))
            at = 0
            while at < batch.num_rows:
                done = int(ends[at - 1]) if at else 0
                size = max(1, min(most - n, int(np.searchsorted(ends, done + POSTINGS - postings, "right")) - at))
                shard.append(batch.slice(at, size))
                n, at = n + shard[-1].num_rows, at + size
                postings += int(ends[min(at, len(ends)) - 1]) - done
                if n >= most or postings >= POSTINGS:
                    walk()
                    n = postings = 0
        if n:
            walk()
        for k, (scores, ids) in enumerate(best):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), k)), pa.array(scores), pa.array(ids)], names=["item", "score", "id"])

    return index.where("not stats").select("id", "n", "ids", "counts").mapInArrow(run, "item long, score long, id long")


def item_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Distinct (item, text) in blocks of at most about BLOCK_TERMS distinct terms and BLOCK_PAIRS terms, dealt by a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t, n) for text in batch.column(0).to_pylist() for t, n in term_counts(text).items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())], names=["term", "n"])

    words = items.select("text").mapInArrow(run, "term binary, n long").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    distinct, pairs = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    k = pieces(pairs, BLOCK_PAIRS if distinct <= BLOCK_TERMS else BLOCK_TERMS)
    for i in range(k):
        yield [(r["item"], r["text"]) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(k)) == i).orderBy("item", "text").toLocalIterator()]


def best_documents(docs: DataFrame, benchmark: DataFrame, places: int = PLACES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item, rank, id, score: for each item its documents with the highest scores above 0, equal scores by ascending id.

    Null and empty texts have no term: as documents they count nowhere, as items they have no rows. Equal rows of the benchmark
    are one item; equal ids with different texts are ranked apart. A document whose id is null counts in the statistics
    and isn't ranked; rows with equal ids are documents of their own, with ranks of their own. Empty tables give an empty
    result. Other columns are not read. The items are the query set, in blocks of bounded size: each block is one pass over
    the documents.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = benchmark.schema[item_col].dataType
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null").distinct()
    out = None
    for block in item_blocks(items):
        counts = [term_counts(t) for _, t in block]
        terms = {t: k for k, t in enumerate(sorted({t for c in counts for t in c}))}
        index = indexed(docs, terms, id_col, text_col)
        n_docs, n_all = index.where("stats").agg(F.sum("id"), F.sum("n")).first()
        pairs = index.where("stats").select(F.explode(F.arrays_zip("ids", "counts")).alias("e")).select("e.ids", "e.counts")
        df = {r[0]: r[1] for r in pairs.groupBy("ids").agg(F.sum("counts")).collect()}
        weighted = []
        for c in counts:
            own = {terms[t]: n * weight(n_docs, df[terms[t]]) for t, n in c.items() if terms[t] in df}
            weighted.append((np.array(list(own), np.int64), np.array(list(own.values()), np.int64)))
        names = spark.createDataFrame([(k, item) for k, (item, _) in enumerate(block)], f"item long, name {kind.simpleString()}")
        if n_all:
            first = Window.partitionBy("item").orderBy(F.desc("score"), "id")
            found = searched(index, weighted, len(terms), n_docs, n_all, places).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= places)
            found = found.join(F.broadcast(names), "item").select(F.col("name").alias("item"), "rank", "id", "score")
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], f"item {kind.simpleString()}, rank int, id long, score long") if out is None else out
