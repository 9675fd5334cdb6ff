"""SimHash near-duplicates: 64-bit fingerprints, an inverted index on byte positions with count filtering, connected groups.

Fingerprints that differ in at most 3 of 64 bits differ in at most 3 of their 8 bytes, so they share at least LEAST_SHARED = 5
bytes at equal positions. The index posts the bytes of a fingerprint by position. A list of one byte would hold a 256th of all rows, so
a posting has three bytes at three positions of one half: of 5 shared positions at least 3 lie in one half, so the 4 + 4
triples bring every pair together that can reach the count. For each pair that meets in a list the positions with equal bytes are
tallied; pairs with fewer than LEAST_SHARED go, and the others' bits are verified.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected
from tidemark.llm.links import linked
from tidemark.llm.rows import joined_hot, map_batches, parted, prepare, stored

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Of the 8 byte positions, what a pair within MAX_BITS shares at least.
LEAST_SHARED = 8 - MAX_BITS
#: Shingles whose bits are added up at a time.
CHUNK = 1 << 16
#: Byte positions of the postings: the triples of either half.
TRIPLES = tuple(t for half in (range(4), range(4, 8)) for t in combinations(half, 3))


def fingerprint(text: str | None) -> int:
    """The fingerprint as an unsigned number: null, empty and blank texts have 0."""
    return _fingerprint((text or "").encode("utf-8", "surrogatepass"))


def _fingerprint(raw: bytes) -> int:
    words = raw.lower().split()  # of bytes: A-Z only, and cut at the six ASCII white spaces
    n = len(words)
    if not n:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if n <= SHINGLE:
        return int.from_bytes(digest(joined, SEED), "big")
    ends = list(accumulate(map(len, words)))
    ends = [e + i for i, e in enumerate(ends)]
    starts = [0, *(e + 1 for e in ends[: n - SHINGLE])]
    ends = ends[SHINGLE - 1 :]
    total, counts = len(starts), np.zeros(64, np.int64)
    for at in range(0, total, CHUNK):
        part = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)])
        counts += np.unpackbits(np.frombuffer(part, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, fp) for each row: a hash of the text (of null like of empty) and the fingerprint as a signed long."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([_fingerprint(x) for x in batch.column(2).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["id", "th", "fp"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    frame = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("raw"))
    return map_batches(frame, work, "id long, th long, fp long")


def _mask(triple: tuple[int, ...]) -> int:
    return int(np.array(sum(255 << (8 * i) for i in triple), np.uint64).astype(np.int64))


def shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The tally: at how many of the 8 byte positions two fingerprints have the same byte."""
    return 8 - np.count_nonzero((a ^ b).view(np.uint8).reshape(-1, 8), axis=1)


def _near(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Pairs that reach the count; their bits are verified."""
    out = shared_bytes(a, b) >= LEAST_SHARED
    out[out] = np.bitwise_count(a[out] ^ b[out]) <= max_bits
    return out


def _pairs(max_bits: int) -> Callable[[dict], Callable]:
    def pairs(rows: dict) -> Callable:
        values = rows["node"].view(np.uint64)
        return lambda a, b: _near(values[a], values[b], max_bits)

    return pairs


def _test(max_bits: int) -> Callable[[dict], tuple]:
    def test(group: dict) -> tuple:
        values = group["node"].view(np.uint64)
        return [lambda i, js: _near(values[js], np.full(len(js), values[i]), max_bits)], None

    return test


def links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints of column fp wherever links of up to 3 bits connect them."""
    if max_bits > MAX_BITS:
        raise ValueError("the postings are complete up to 3 differing bits")
    posts = F.explode(F.array([F.struct(F.lit(j).alias("j"), F.col("fp").bitwiseAND(F.lit(_mask(t))).alias("k")) for j, t in enumerate(TRIPLES)]))
    keyed = nodes.select("fp", posts.alias("post")).select("post.j", "post.k", F.col("fp").alias("node"))
    return linked(keyed, ["j", "k"], _pairs(max_bits), _test(max_bits))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fp, component_id) for each row of docs; component_id is the least id that links reach, its own included.

    Null, empty and blank texts have fingerprint 0 and link like any other. Repeated rows are linked and all are
    returned. A null id is returned with the least id of its group (null if the group has none). An
    empty table gives an empty result; other columns are not read.
    """
    return _grouped(docs, id_col, text_col, max_bits).select("id", "fp", "component_id")


def _grouped(docs: DataFrame, id_col: str, text_col: str, max_bits: int) -> DataFrame:
    """(id, th, fp, component_id, root); root is the least fingerprint of the group."""
    prepare(docs.sparkSession)
    marked = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = connected(links(nodes, max_bits))
    groups = stored(nodes.join(roots.hint("merge"), nodes["fp"] == roots["node"], "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root")), "groups")
    least = groups.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m"))
    found = stored(joined_hot(groups, least, ["root"], "m", groups.count()).select("fp", "n", "component_id", "root"), "found")
    return joined_hot(marked, found, ["fp"], "n", marked.count()).select("id", "th", "fp", "component_id", "root")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row of docs, with all its columns, for each group of near-duplicates: the one with the least id.

    Of rows with that id the one with the least hash of its text stays, of equal rows one. A row with a null id
    stays only if its group has no id. An empty table gives an empty result. The choice is made on ids and hashes; whole texts are
    not sorted, and only those of rows that come again are compared.
    """
    found = _grouped(docs, id_col, text_col, max_bits)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "th")).alias("r"), F.count(F.lit(1)).alias("m"))
    gone = stored(joined_hot(found, first, ["root"], "m", found.count()).where(~(F.col("id").eqNullSafe(F.col("r.id")) & (F.col("th") == F.col("r.th")))).select("id", "th"), "gone")
    again = found.groupBy("id", "th").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("id", "th")
    own, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # A null id can't be joined; it is told from all others by its own column.
    both = docs.withColumns({"__tm_no": own.isNull(), "__tm_own": F.coalesce(own, F.lit(0)), "__tm_hash": F.xxhash64(text)})
    keys = ["__tm_no", "__tm_own", "__tm_hash"]
    named = lambda rows: rows.select(F.col("id").isNull().alias("__tm_no"), F.coalesce("id", F.lit(0)).alias("__tm_own"), F.col("th").alias("__tm_hash"))
    may, rest = parted(both, named(gone), keys)
    kept = may.join(named(gone).hint("merge"), keys, "left_anti").unionByName(rest)
    twice, rest = parted(kept, named(again), keys)
    return twice.dropDuplicates(keys).unionByName(rest).select(*docs.columns)
