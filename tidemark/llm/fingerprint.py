"""Document fingerprints by consistent weighted sampling.

A text is a set of words weighted by how often each comes. For each of SAMPLES slots every word draws, from its own
hash alone, r and c from Gamma(2, 1) and b from Uniform(0, 1), and takes the step t = floor(ln w / r + b) and the value
ln a = ln c - r (t - b) - r; the slot keeps the word and step of the least value (Ioffe 2010). The share of slots on
which two texts agree has their generalised Jaccard similarity, sum of min over sum of max weights, as expectation.
A slot is stored as 16 bits of a hash of word and step, so unlike slots agree by chance once in 65,536.

Draws are made from a word's hash alone; those of the latest words are kept, which changes no result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.rows import map_batches, prepare

SAMPLES = 64
SEED = 7
#: Words of which a worker keeps the draws.
CACHE_WORDS = 65_536
#: Words drawn at a time.
BLOCK = 4096
GOLD, MUL_A, MUL_B = (np.array(x, np.uint64) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_SLOT = (np.arange(SAMPLES, dtype=np.uint64) * np.uint64(8) + np.uint64(1)) * GOLD


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MUL_A
    x = (x ^ (x >> np.uint64(27))) * MUL_B
    return x ^ (x >> np.uint64(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2**-24)


def draws(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(r, b, ln c - r, mark) for word hashes: a row for each word, a column for each slot, in single precision."""
    base = words[:, None] + _SLOT
    one = _mix(base)
    two = _mix(base + GOLD)
    three = (one ^ (two >> np.uint64(23))) * MUL_A
    # Two 24-bit uniforms of one hash: its upper bits and those below.
    low = lambda x: _uniform(x << np.uint64(24))
    r = -np.log(_uniform(one) * low(one))
    c = -np.log(_uniform(two) * low(two))
    return r, _uniform(three), np.log(c) - r, ((three >> np.uint64(24)) & np.uint64(0xFFFF)).astype(np.uint16)


class Draws:
    """Rows of draws by word. New words take the places of those that came first, so a text's words are still there for the
    next texts; a word that comes again after it went is drawn again, the same."""

    def __init__(self) -> None:
        self.at: dict[bytes, int] = {}
        self.words: list[bytes | None] = [None] * CACHE_WORDS
        self.next = 0
        shape = (CACHE_WORDS, SAMPLES)
        self.r, self.b, self.v, self.one = (np.empty(shape, np.float32) for _ in range(4))
        self.mark = np.empty(shape, np.uint16)

    def rows(self, words: list[bytes]) -> np.ndarray:
        """Places of at most BLOCK distinct words, none of which puts out another."""
        get, n = self.at.get, len(words)
        if self.next + n > CACHE_WORDS:
            self._free(self.next, CACHE_WORDS)
            self.next = 0
        # Words that lie where new ones may go are moved on, so they aren't lost meanwhile.
        low, high = self.next, self.next + n
        found = [get(w, -1) for w in words]
        new = [w for w, i in zip(words, found, strict=True) if i < 0 or low <= i < high]
        if new:
            self._free(low, low + len(new))
            rows = slice(low, low + len(new))
            for k in range(0, len(new), 512):
                own = slice(low + k, min(low + k + 512, low + len(new)))
                r, b, v, mark = draws(hashes(new[k : k + 512]))
                self.r[own], self.b[own], self.v[own], self.mark[own] = r, b, v, mark
                self.one[own] = v + r * b  # the value at weight 1, where the step is 0
            self.words[rows] = new
            self.at.update(zip(new, range(low, low + len(new)), strict=True))
            self.next = low + len(new)
            found = [get(w) for w in words]
        return np.array(found)

    def _free(self, start: int, end: int) -> None:
        for k in range(start, end):
            w = self.words[k]
            if w is not None and self.at.get(w) == k:
                del self.at[w]
            self.words[k] = None


@lru_cache(1)
def held() -> Draws:
    return Draws()


def hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(w, SEED) for w in words]), ">u8").astype(np.uint64)


def signature(text: str | None) -> np.ndarray | None:
    """The slots of a text; None if it has no word."""
    weights = Counter((text or "").lower().encode("utf-8", "surrogatepass").split())
    if not weights:
        return None
    store, slots = held(), np.arange(SAMPLES)
    words, counts = list(weights), np.array(list(weights.values()))
    best, kept = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint16)

    def least(value: np.ndarray, code: np.ndarray, step: np.ndarray | None = None) -> None:
        at = value.argmin(axis=0)
        low, mark = value[at, slots], code[at, slots]
        if step is not None:
            # Step 0 leaves the mark as it is, as at weight 1.
            mark = mark ^ (_mix(step[at, slots].astype(np.int64).astype(np.uint64) * GOLD) & np.uint64(0xFFFF)).astype(np.uint16)
        less = low < best
        best[less], kept[less] = low[less], mark[less]

    for k in range(0, len(words), BLOCK):
        rows, count = store.rows(words[k : k + BLOCK]), counts[k : k + BLOCK]
        once = rows[count == 1]
        if len(once):
            least(store.one[once], store.mark[once])
        if len(once) < len(rows):
            own, logs = rows[count > 1], np.log(count[count > 1]).astype(np.float32)
            r, b = store.r[own], store.b[own]
            step = np.floor(logs[:, None] / r + b)
            least(store.v[own] - r * (step - b), store.mark[own], step)
    return kept


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Share of slots that agree; two texts without words are alike."""
    if a is None or b is None:
        return float(a is b)
    return float((a == b).mean())


def written(slots: np.ndarray | None) -> str:
    """Four hex digits a slot; empty for a text without words."""
    return "" if slots is None else slots.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) for each row. Null, empty and blank texts have the empty fingerprint; equal texts have equal ones.

    Repeated rows and null ids are returned as they come; other columns are not read; an empty table gives an empty result.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [written(signature(x)) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["id", "fingerprint"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), work, "id long, fingerprint string")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Rows (part, late, id, text), sorted in each partition so that each row's next one follows it.

    The order is descending ids (equal ids by text, null ids last); after the last comes the first. Ids at quantiles
    cut the order into parts; a part also gets, marked late, a copy of the row that follows its last. One
    shuffle of the texts; the driver gets `parts` ids. A row may come twice as late, the first counts.
    """
    spark = docs.sparkSession
    prepare(spark)
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    quantiles = [i / parts for i in range(1, parts)] or [0.5]
    stats = rows.agg(F.percentile_approx("id", F.array([F.lit(q) for q in quantiles]), max(1000, 20 * parts)).alias("q"), F.max("id").alias("first"), F.count(F.when(F.col("id").isNull(), 1)).alias("nulls")).first()
    cuts = np.array(sorted(set(stats["q"] or [])) if parts > 1 else [], np.int64)  # part k holds ids in (cuts[n-1-k], cuts[n-k]]
    first, n = stats["first"], len(cuts)
    last_part = n + 1 if stats["nulls"] else n

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            known = np.array(ids.is_valid())
            values = np.array(ids.fill_null(0))
            part = np.where(known, n - np.searchsorted(cuts, values, side="left"), n + 1)
            own = pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(np.zeros(len(part), bool)), ids, batch.column(1)], names=["part", "late", "id", "text"])
            yield own
            # A row at a cut follows the part above; the greatest id follows the last part; null ids follow the lowest id.
            for chosen, to in ((known & np.isin(values, cuts), part - 1), (known & (values == first), np.full(len(part), last_part))):
                if (at := np.flatnonzero(chosen)).size:
                    yield pa.RecordBatch.from_arrays([pa.array(to[at].astype(np.int32)), pa.array(np.ones(len(at), bool)), ids.take(pa.array(at)), batch.column(1).take(pa.array(at))], names=["part", "late", "id", "text"])
            if last_part == n + 1 and (at := np.flatnonzero(~known)).size:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, np.int32)), pa.array(np.ones(len(at), bool)), ids.take(pa.array(at)), batch.column(1).take(pa.array(at))], names=["part", "late", "id", "text"])

    dealt = rows.mapInArrow(deal, "part int, late boolean, id long, text string")
    return dealt.repartitionById(last_part + 1, F.col("part")).sortWithinPartitions("part", "late", F.desc_nulls_last("id"), "text")


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as many code points (or all) of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    A row is held against its edited text (see edited()) and against the next row by descending id; equal ids are taken by
    text, null ids last, and after the last row comes the first. A null text counts as empty. A single row is its own
    next one. Repeated rows are returned as often as they come; other columns are not read; an empty table gives an
    empty result.
    """
    import hashlib

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the last row whose next one is still to come: part, id, text, slots
        for batch in batches:
            out = []
            for part, late, key, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if late and (before is None or before[0] != part):
                    before = None
                    continue
                text = text or ""
                slots = signature(text)
                if before is not None and before[0] == part:
                    _, own, mine, sign = before
                    new = edited(mine, text)
                    other = signature(new)
                    out.append((own, len(mine), hashlib.sha256(new.encode("utf-8")).hexdigest(), written(sign), written(other), likeness(sign, other), likeness(sign, slots)))
                before = None if late else (part, key, text, slots)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return with_next(docs, id_col, text_col, parts).mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
