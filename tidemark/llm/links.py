"""Edges that connect what links connect, found bucket by bucket, without emitting all pairs of a bucket.

A bucket holds the nodes that share a key. Inside it a search goes from node to node and compares each one only with
nodes that no search has reached, so a tight bucket of m nodes costs about m comparisons and gives m - 1 edges.

A crowded bucket is cut into blocks, so that no task holds more than a block. Its blocks are searched first; then one node
of each component that the blocks left; and at last the nodes outside the bucket's largest component against all its
blocks. Nodes that are connected already are not compared again, so each node of the largest component is sent to one task, and
the result still connects all that any pair of the bucket's nodes would.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import connected
from tidemark.llm.rows import joined_hot, prepare, stored

#: Nodes of a block.
BLOCK = 4096
#: One row in SAMPLE is looked at to find crowded buckets: those with CROWD sampled rows and at least one in SHARE of all of these.
SAMPLE, CROWD, SHARE = 32, 64, 10_000
#: Buckets of so many rows are compared all at once.
SMALL = 16
Near = Callable[[int, np.ndarray], np.ndarray]
#: Given the columns of a bucket: functions near(i, js), which of js may be linked with i, from the strictest to the one that
#: leaves none out, and agree(i, js), which of js are linked with i (None: those that are near).
Test = Callable[[dict], tuple[list[Near], Near | None]]
#: Buckets of so many rows or fewer go together to a function of their columns and the number of each row's bucket, which gives edges.
Small = tuple[int, Callable[[dict, np.ndarray], list[tuple]]]


def forest(n: int, near: Near, agree: Near | None = None, wider: Sequence[Near] = ()) -> list[tuple[int, int]]:
    """Edges (i, j) of a spanning forest of the links among n nodes.

    With wider functions the nearest pairs are looked at first, and of the others only those that these leave in different trees.
    """
    edges: list[tuple[int, int]] = []
    rest, own = np.arange(n), np.zeros(n, int)
    while len(rest):
        root, queue, rest = int(rest[0]), [int(rest[0])], rest[1:]
        own[root] = root
        while queue and len(rest):
            i = queue.pop()
            hit = near(i, rest)
            if not hit.any():
                continue
            if agree:
                hit[hit] = agree(i, rest[hit])
            found = rest[hit]
            rest, own[found] = rest[~hit], root
            edges += [(i, int(j)) for j in found]
            queue += found.tolist()
    for more in wider:
        edges += _joins(own, np.ones(n, bool), more, agree)
    return edges


def _joins(own: np.ndarray, moving: np.ndarray, near: Near, agree: Near | None) -> list[tuple[int, int]]:
    """bridges, with labels as numbers, which are changed as edges join them."""
    edges: list[tuple[int, int]] = []
    for i in np.flatnonzero(moving):
        js = np.flatnonzero((own != own[i]) & (~moving | (np.arange(len(own)) > i)))
        js = js[near(int(i), js)] if len(js) else js
        if agree and len(js):
            js = js[agree(int(i), js)]
        for j in js:
            if own[j] != own[i]:
                edges.append((int(i), int(j)))
                own[own == own[j]] = own[i]
    return edges


def bridges(labels: list, moving: np.ndarray, near: Near, agree: Near | None = None) -> list[tuple[int, int]]:
    """Edges between nodes of different labels, a moving node with any other; labels that an edge joins count as one."""
    return _joins(np.unique(np.array(labels, object).astype(str), return_inverse=True)[1], moving, near, agree)


def _values(column: pa.ChunkedArray) -> np.ndarray | list:
    """A column's values: an array of numbers, an array for each list of numbers, else Python objects."""
    if pa.types.is_primitive(column.type):
        return column.to_numpy()
    if not pa.types.is_list(column.type) or not column.num_chunks or column.null_count or not pa.types.is_primitive(column.type.value_type):
        return column.to_pylist()
    out = []
    for chunk in column.chunks:
        flat, ends = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_pylist()
        out += [flat[i:j] for i, j in zip(ends, ends[1:])]
    return out


def edges_of(rows: DataFrame, group: list[str], work: Callable[[dict], list[tuple]], columns: list[str], schema: str, small: Small | None = None) -> DataFrame:
    """work gets the columns of one bucket (or block) and gives rows of the schema; small, if given, those of many small ones at once."""
    prepare(rows.sparkSession)
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def done(table: pa.Table, ends: np.ndarray) -> list[tuple]:
            out: list[tuple] = []
            cols = {c: _values(table[c]) for c in columns}
            starts = np.append(0, ends[:-1])
            size = ends - starts
            one = (size > 1) & (size > (small[0] if small else 0))
            for start, end in zip(starts[one], ends[one], strict=True):
                out += work({c: v[start:end] for c, v in cols.items()})
            rest = np.repeat((size > 1) & ~one, size)
            if small and rest.any():
                at = np.flatnonzero(rest)
                out += small[1]({c: v[at] if isinstance(v, np.ndarray) else [v[i] for i in at] for c, v in cols.items()}, np.repeat(np.arange(len(size)), size)[at])
            return out

        def emit(out: list[tuple]) -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*out, strict=True)], names=names)

        def cuts(table: pa.Table) -> np.ndarray:
            change = np.zeros(max(0, table.num_rows - 1), bool)
            for c in group:
                v = table[c].to_numpy()
                change |= v[1:] != v[:-1]
            return np.flatnonzero(change) + 1

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(x.num_rows for x in held) < 4096:
                continue
            table = pa.concat_tables(held)
            ends = cuts(table)
            if len(ends):
                yield from emit(done(table, ends))
                table = table.slice(int(ends[-1]))
            held = [table]
        if held:
            table = pa.concat_tables(held)
            yield from emit(done(table, np.append(cuts(table), table.num_rows)))

    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, schema).distinct()


def crowded(sample: DataFrame, group: list[str]) -> DataFrame | None:
    """The crowded buckets of a sample of one row in SAMPLE, at most SHARE of them; None if there are none."""
    counts = stored(sample.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= CROWD), "crowded")
    total = counts.agg(F.sum("__n")).first()[0]
    return counts.where(F.col("__n") * SHARE >= total).select(*group) if total else None


def hits(starts: np.ndarray, n: int, pairs: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Which of n rows, sorted by bucket, are in a pair of their bucket; pairs(a, b) tells of rows a[k] and b[k]."""
    out = np.zeros(n, bool)
    size = np.diff(np.append(starts, n))
    run = np.repeat(np.where(size <= SMALL, np.arange(len(starts)), -1), size)
    for d in range(1, SMALL):
        at = np.flatnonzero((run[d:] == run[:-d]) & (run[d:] >= 0))
        if not len(at):
            break
        at = at[pairs(at, at + d)]
        out[at] = out[at + d] = True
    for s, m in zip(starts[size > SMALL], size[size > SMALL], strict=True):
        rows = np.arange(s, s + m)
        for i in rows:
            if not out[i]:
                others = rows[rows != i]
                others = others[pairs(np.full(m - 1, i), others)]
                out[others] = True
                out[i] = len(others) > 0
    return out


def sieved(members: DataFrame, group: list[str], kept: list[str], pairs: Callable[[dict], Callable[[np.ndarray, np.ndarray], np.ndarray]]) -> DataFrame:
    """group and kept columns, and n (rows of the bucket), of the rows that are in a pair of their bucket; of buckets over BLOCK all rows."""
    prepare(members.sparkSession)
    columns = [*group, *kept]
    schema = ", ".join(f"{c} {members.schema[c].dataType.simpleString()}" for c in columns) + ", n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def change(table: pa.Table) -> np.ndarray:
            out = np.zeros(max(0, table.num_rows - 1), bool)
            for c in group:
                v = table[c].to_numpy()
                out |= v[1:] != v[:-1]
            return np.flatnonzero(out) + 1

        def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
            starts = np.append(0, change(table))
            n = np.repeat(np.diff(np.append(starts, table.num_rows)), np.diff(np.append(starts, table.num_rows)))
            out = n > BLOCK
            at = np.flatnonzero((n > 1) & ~out)
            if len(at):
                part = table.take(pa.array(at))
                out[at] = hits(np.append(0, change(part)), len(at), pairs({c: _values(part[c]) for c in part.column_names}))
            if out.any():
                yield from table.select(columns).append_column("n", pa.array(n, pa.int64())).filter(pa.array(out)).combine_chunks().to_batches()

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(x.num_rows for x in held) < 16384:
                continue
            table = pa.concat_tables(held).combine_chunks()
            ends = change(table)
            if len(ends):
                yield from found(table.slice(0, int(ends[-1])))
                table = table.slice(int(ends[-1]))
            held = [table]
        if held and sum(x.num_rows for x in held):
            yield from found(pa.concat_tables(held).combine_chunks())

    return members.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, schema)


def linked(members: DataFrame, group: list[str], pairs: Callable[[dict], Callable], test: Test, payload: DataFrame | None = None, on: list[str] | None = None, block: int = BLOCK, small: Small | None = None) -> DataFrame:
    """Edges (a, b), stored, that connect the nodes of each bucket as all links between its nodes do.

    members: the columns of group, `node` and what pairs needs, which tells rows that can't be linked; payload, if given, has
    what test needs, once for each value of the columns `on`. small finds the edges of small buckets.
    """
    kind = members.schema["node"].dataType.simpleString()
    schema = f"a {kind}, b {kind}"
    kept = ["node", *[c for c in on or [] if c not in ("node", *group)]]
    crowd = crowded(members.where(F.pmod(F.xxhash64(F.lit("crowd"), "node"), F.lit(SAMPLE)) == 0), group)
    if crowd is None:
        held = sieved(members, group, kept, pairs)
    else:
        many = members.join(F.broadcast(crowd), group, "left_semi").select(*group, *kept)
        sizes = many.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
        held = sieved(members.join(F.broadcast(crowd), group, "left_anti"), group, kept, pairs).unionByName(many.join(F.broadcast(sizes), group))
    held = stored(held.withColumn("nb", F.ceil(F.col("n") / block).cast("int")).withColumn("b", F.pmod(F.xxhash64("node", *group), F.col("nb")).cast("int")).drop("n"), "members")
    columns = ["node", *(c for c in (payload.columns if payload is not None else []) if c != "node"), *(c for c in group if payload is None or c not in payload.columns)]

    def whole(rows: DataFrame) -> DataFrame:
        return rows if payload is None else rows.join(payload.hint("merge"), on)

    def within(group_: dict) -> list[tuple]:
        near, agree = test(group_)
        return [(group_["node"][i], group_["node"][j]) for i, j in forest(len(group_["node"]), near[0], agree, near[1:])]

    def across(group_: dict) -> list[tuple]:
        near, agree = test(group_)
        return [(group_["node"][i], group_["node"][j]) for i, j in bridges(list(group_["root"]), np.array(group_["moving"], bool), near[-1], agree)]

    edges = stored(edges_of(whole(held), [*group, "b"], within, columns, schema, small), "edges")
    big = held.where("nb > 1")
    if big.isEmpty():
        return edges

    def labelled(found: DataFrame) -> DataFrame:
        roots = connected(found)
        return stored(big.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")), "labelled")

    first = labelled(edges).groupBy(*group, "root", *kept[1:]).agg(F.min("node").alias("node"))
    counts = first.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    first = joined_hot(first, counts, group, "__n", first.count()).withColumn("b", F.pmod(F.xxhash64("node", *group), F.ceil(F.col("__n") / block)).cast("int"))
    edges = edges.unionByName(stored(edges_of(whole(first.drop("__n", "root")), [*group, "b"], within, columns, schema), "edges"))
    now = labelled(edges)
    parts = now.groupBy(*group, "root").agg(F.count(F.lit(1)).alias("m"))
    most = parts.groupBy(*group).agg(F.max_by("root", F.struct("m", "root")).alias("top"), F.count(F.lit(1)).alias("kinds"), F.sum("m").alias("__n")).where("kinds > 1")
    last = joined_hot(now, most, group, "__n", now.count()).withColumn("moving", F.col("root") != F.col("top"))
    last = last.withColumn("b", F.explode(F.when(F.col("moving"), F.sequence(F.lit(0), F.col("nb") - 1)).otherwise(F.array("b")))).drop("__n", "top", "kinds")
    return edges.unionByName(stored(edges_of(whole(last), [*group, "b"], across, [*columns, "root", "moving"], schema), "edges"))
