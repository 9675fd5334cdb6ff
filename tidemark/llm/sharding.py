"""Sharding along a Hilbert curve over several metadata dimensions, for pruning files by any of them.

Each dimension is quantised to BITS bits, in its own order, by quantiles of the rows. A cell's index on the Hilbert curve orders the
rows, and the order is cut into runs of equal row counts. Near cells have near indexes, so a shard covers few values of each
dimension, and minima and maxima of its files rule out most shards for a filter on any of them.

Equal texts form a group and take the least index of their cells, so a group stays together, and no more groups than there are
cuts lie on both sides of one. A group may hold any share of the rows; being cut by rows, it doesn't unbalance the shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.rows import prepare, stored

BITS = 5
SHARDS = 16


def hilbert(cell: Sequence[int], bits: int) -> int:
    """Index of a cell on the Hilbert curve: Gray code and rotation by level (after Hamilton 2006)."""
    n = len(cell)
    mask = (1 << n) - 1
    entry, direction, out = 0, 0, 0
    turn = lambda x, k: ((x >> k) | (x << (n - k))) & mask if k % n else x
    for level in range(bits - 1, -1, -1):
        corner = sum(((c >> level) & 1) << k for k, c in enumerate(cell))
        gray = turn(corner ^ entry, (direction + 1) % n)
        place, shift = gray, 1
        while shift < n:
            place ^= place >> shift
            shift <<= 1
        out = (out << n) | place
        even = 0 if place == 0 else 2 * ((place - 1) // 2)
        start = even ^ (even >> 1)
        back = (direction + 1) % n
        entry ^= ((start << back) | (start >> (n - back))) & mask
        ones = place if place & 1 else place - 1
        trail = 0 if place == 0 else (((ones + 1) & -(ones + 1)).bit_length() - 1)
        direction = (direction + trail + 1) % n
    return out


def curve(dims: int, bits: int = BITS) -> list[int]:
    """The index of every cell; a cell's number has the first dimension's bits lowest."""
    size = 1 << bits
    return [hilbert([(c >> (bits * k)) & (size - 1) for k in range(dims)], bits) for c in range(size**dims)]


#: Distinct values of a category that the driver sorts; more are sorted over ranges.
FEW = 4096


def category(column: str) -> Column:
    """A category's whole value with the order of texts; null comes before all."""
    return F.coalesce(F.concat(F.lit("1"), F.col(column).cast("string")), F.lit("0"))


def text_bounds(values: DataFrame, bits: int = BITS) -> list[str]:
    """Values that cut the rows of one column of texts into runs of about equal counts, fewer than 2 ** bits of them: whole values, however many there are."""
    (column,) = values.columns
    counts = stored(values.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n")), "hilbert-values")
    few = counts.limit(FEW + 1).collect()
    if len(few) <= FEW:
        held = sorted((r["v"].encode(), r["v"], r["n"]) for r in few)
        total, upto, firsts = sum(n for _, _, n in held), 0, {}
        for _, v, n in held:
            upto += n
            # v is the quantile of every share that its rows reach.
            firsts.setdefault((upto << bits) // max(total, 1), v)
    else:
        ordered = stored(counts.repartitionByRange("v").sortWithinPartitions("v").withColumn("at", F.monotonically_increasing_id()), "hilbert-values").withColumn("part", F.shiftright("at", 33))
        before, total = {}, 0
        for part, n in sorted(ordered.groupBy("part").agg(F.sum("n")).collect()):
            before[part], total = total, total + n
        offsets = values.sparkSession.createDataFrame(list(before.items()), "part long, before long")
        upto = F.sum("n").over(Window.partitionBy("part").orderBy("at")) + F.col("before")
        runs = ordered.join(F.broadcast(offsets), "part").select(F.expr(f"{1 << bits}L").alias("k"), "v", upto.alias("upto"))
        firsts = dict(runs.groupBy(F.floor(F.col("upto") * F.col("k") / total).alias("k")).agg(F.min("v")).collect())
    # Of the shares k / 2 ** bits, each has the first value that reaches it; the last value needs no bound.
    reached, out = sorted(firsts.items()), []
    for k in range(1 << bits):
        out.append(next(v for share, v in reached if share >= k) if reached else None)
    last = reached[-1][1] if reached else None
    return sorted({v for v in out if v is not None and v != last}, key=str.encode)


def quantised(value: Column, bounds: Sequence[int] | Sequence[str], bits: int = BITS) -> Column:
    """How many of the bounds lie below the value, spread over all numbers of the bits."""
    most = (1 << bits) - 1
    rank = sum(((value > F.lit(b)).cast("int") for b in bounds), F.lit(0))
    return F.floor(rank * most / max(1, len(bounds))).cast("int")


def bounds_of(values: DataFrame, bits: int = BITS) -> list[list]:
    """For each column, of numbers or of texts, values that cut its rows into runs of about equal counts, fewer than 2 ** bits of them."""
    shares = [k / (1 << bits) for k in range(1 << bits)] + [1.0]
    numbers = [c for c, kind in values.dtypes if kind != "string"]
    found = values.agg(*[F.percentile_approx(c, shares, 10_000).alias(c) for c in numbers]).first() if numbers else {}
    # A bound is a value that rows have; each lies above the one before, the last value needs none.
    return [sorted(set(found[c] or []))[:-1] if c in numbers else text_bounds(values.select(c), bits) for c in values.columns]


def dimensions(docs: DataFrame, categories: Sequence[str], text_col: str = "text") -> DataFrame:
    """docs with __tm_0 (bytes of the text plus 1), __tm_1 ... (the categories, as texts)."""
    size = F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long") + 1
    return docs.withColumns({"__tm_0": size} | {f"__tm_{k}": category(c) for k, c in enumerate(categories, 1)})


def placed(docs: DataFrame, categories: Sequence[str] = ("lang", "source"), shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, crc, hilbert, shard, slot) for each row.

    Rows of equal index are ordered by the text's hash, its crc and size, and the id, nulls first; rows equal in all of these are alike. size is the text's bytes plus 1. Row counts of shards differ by at most one; slots run from 0 without gaps in curve order. A null text
    counts as no bytes (crc 0) and is equal to the empty text's group; null categories and ids have places of
    their own; repeated rows get slots of their own. Categories that docs lacks are left out. Other columns are not read; an
    empty table gives an empty result. The driver gets a number per sorted partition; texts are not shuffled.
    """
    spark = docs.sparkSession
    prepare(spark)
    categories = [c for c in categories if c in docs.columns]
    docs = dimensions(docs, categories, text_col)
    names = [f"__tm_{k}" for k in range(1 + len(categories))]
    bounds = bounds_of(docs.select(*names))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.col(names[0])
    cell = sum((F.shiftleft(quantised(F.col(c), b), BITS * k) for k, (c, b) in enumerate(zip(names, bounds, strict=True))), F.lit(0))
    table = spark.createDataFrame(list(enumerate(curve(1 + len(categories)))), "cell int, own long")  # 2 ** (BITS * dimensions) rows, whatever the input
    rows = docs.select(F.col(id_col).cast("long").alias("id"), size.alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("th"), cell.cast("int").alias("cell")).join(F.broadcast(table), "cell").drop("cell").checkpoint()
    groups = rows.groupBy("th", "crc", "size").agg(F.min("own").alias("hilbert"), F.count(F.lit(1)).alias("n"), F.max("own").alias("last")).where("n > 1 and hilbert < last")
    total = rows.count()
    # Of groups with more than a thousandth of all rows there are fewer than 1,000: these are broadcast, the rest joined by shuffle.
    keys = ["th", "crc", "size"]
    groups = groups.checkpoint()
    hot = groups.where(F.col("n") * 1000 > total).select(*keys, F.col("hilbert").alias("hot"))
    moved = rows.join(F.broadcast(hot), keys, "left")
    cold = groups.where(F.col("n") * 1000 <= total).select(*keys, "hilbert")
    moved = moved.where("hot is null").join(cold, keys, "left").select("id", *keys, F.coalesce("hilbert", "own").alias("hilbert")).unionByName(moved.where("hot is not null").select("id", *keys, F.col("hot").alias("hilbert")))
    order = ["hilbert", "th", "crc", "size", "id"]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = moved.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)).checkpoint()
    before, offsets = 0, []
    for r in ranged.groupBy("part").count().orderBy("part").toLocalIterator():
        offsets.append((r["part"], before))
        before += r["count"]
    start = spark.createDataFrame(offsets, "part int, before long")
    rank = F.col("before") + F.col("at")
    out = ranged.join(F.broadcast(start), "part").withColumn("rank", rank).withColumn("shard", F.expr(f"cast(rank * {shards} div {max(1, total)} as int)"))
    return out.select("id", "size", "crc", "hilbert", "shard", F.expr(f"rank - (cast(shard as long) * {total} + {shards - 1}) div {shards}").alias("slot"))


def write_shards(docs: DataFrame, path: str, categories: Sequence[str] = ("lang", "source"), shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes docs as Parquet, a folder `shard=k` for each shard, each in curve order. Ids must be distinct and not null."""
    place = placed(docs, categories, shards, id_col, text_col).select(F.col("id").alias("__tm_id"), "shard", F.col("slot").alias("__tm_slot"))
    rest = [c for c in docs.columns if c != "shard"]
    both = docs.select(*rest).join(place, F.col(id_col).cast("long") == F.col("__tm_id"))
    parts = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both.repartitionByRange(parts, "shard", "__tm_slot").sortWithinPartitions("shard", "__tm_slot").select(*rest, "shard").write.partitionBy("shard").parquet(path)
