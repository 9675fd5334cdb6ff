"""Prefix trie of conversations: who shares which beginning, and what sharing saves.

A turn is known by a 128-bit digest of its role and text, a prefix by the sum, modulo 2^32 in four lanes, of hashes of its
turns with their positions: so a prefix's key comes from running sums, which can be carried on from task to task, and no conversation has
to fit into one. Rows are sorted by (conversation, turn) over ranges, whatever a conversation's length.

Nodes are the distinct prefixes. Those with more than SHARD rows (of turns, over all members) in their subtree are heavy; the light subtrees
below them are the shards. A task builds the tries of its shards as one LOUDS forest: a bitvector in level order, with a node's number of children in
unary, and label arrays in the same order. Parents come from rank and select on the bits, and rollups from np.add.at from the last level to the first. Heavy
upper levels are merged apart: shards' totals go to their parents by one aggregation, and totals go up the heavy levels by doubling of
distances, in rounds of the logarithm of their depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.rows import map_batches, prepare, stored

#: Rows below a node from which it is heavy; nodes of a forest; ids of a piece.
SHARD, FOREST, PIECE = 20_000, 50_000, 8192
#: Turns that a conversation can take over from the first one of its hundred.
MOST_TAKEN = 5
KEY = ["pos", "k1", "k2"]
LANES = ["l0", "l1", "l2", "l3"]
LOW = 0xFFFFFFFF


def turns_of(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, role, h (digest of role and text), n (code points of the text); rows without a conversation are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    whole = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), F.substring(F.unhex(F.sha2(whole, 256)), 1, 16).alias("h"), F.char_length(text).cast("long").alias("n"))
    return rows.where("conv is not null")


def taken() -> F.Column:
    """How many turns a conversation takes from the first one of its hundred."""
    return (F.crc32(F.col("conv").cast("string")) % 6).cast("long")


def sequences(turns: DataFrame) -> DataFrame:
    """Rows of every conversation in ranges of (conv, kind, turn, ...): kind 0 is its start, 1 turns taken over, 2 its own; `at` numbers all rows."""
    by = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "h")
    heads = turns.where("conv % 100 = 0").withColumn("k", F.row_number().over(by)).where(F.col("k") <= MOST_TAKEN)
    heads = heads.groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("k", "h", "n"))).alias("head"))
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    head = F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), taken().cast("int"))
    led = convs.withColumn("base", F.col("conv") - F.col("conv") % 100).join(heads, "base", "left").select("conv", head.alias("head"))
    first = led.select("conv", F.explode("head").alias("e")).select("conv", F.lit(1).alias("kind"), F.col("e.k").cast("long").alias("turn"), F.lit("").alias("role"), F.col("e.h").alias("h"), F.col("e.n").alias("n"))
    start = convs.select("conv", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("h"), F.lit(0).cast("long").alias("n"))
    both = start.unionByName(first).unionByName(turns.withColumn("kind", F.lit(2)))
    order = ["conv", "kind", F.asc_nulls_first("turn"), "role", "h"]
    rows = both.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "kind", "turn", "h", "n", F.monotonically_increasing_id().alias("at"))
    return stored(rows, "trie-turns").withColumn("part", F.shiftright("at", 33))


def placed(rows: DataFrame, carry: DataFrame) -> DataFrame:
    """The rows that the rebuilt conversations have, with pos (0: the start), whole (turns of the conversation) and lanes of their hash."""
    run = Window.partitionBy("part", "conv")
    upto = run.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own, led = F.when(F.col("kind") == 2, 1).otherwise(0), F.when(F.col("kind") == 1, 1).otherwise(0)
    rows = rows.join(F.broadcast(carry), ["part", "conv"], "left")
    rows = rows.select("*", (F.coalesce("before", F.lit(0)) + F.sum(own).over(upto)).alias("r"), F.coalesce("led", F.sum(led).over(run)).alias("nb"), F.coalesce("own", F.sum(own).over(run)).alias("all"), taken().alias("t"))
    pos = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 1, F.col("turn")).otherwise(F.col("nb") + F.col("r") - F.col("t"))
    rows = rows.where("kind < 2 or r > t").select("conv", "part", "at", "n", "h", pos.cast("long").alias("pos"), (F.col("nb") + F.greatest(F.col("all") - F.col("t"), F.lit(0))).alias("whole"))
    e1, e2 = (F.when(F.col("pos") == 0, 0).otherwise(F.xxhash64(F.lit(k), "pos", "h")) for k in (1, 2))
    rows = rows.withColumns({"e1": e1, "e2": e2}).drop("h")
    return rows.select("*", *[x.alias(c) for c, x in zip(LANES, (F.expr(f"e1 & {LOW}L"), F.expr("shiftrightunsigned(e1, 32)"), F.expr(f"e2 & {LOW}L"), F.expr("shiftrightunsigned(e2, 32)")), strict=True)]).drop("e1", "e2")


def prefixes(rows: DataFrame) -> DataFrame:
    """conv, pos, n, whole, key (k1, k2) of the prefix that ends here and of the one before it (p1, p2)."""
    one, two = (Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, last) for last in (-1, Window.unboundedFollowing))
    runs = rows.groupBy("conv", "part").agg(F.sum(F.when(F.col("kind") == 2, 1).otherwise(0)).alias("o"), F.sum(F.when(F.col("kind") == 1, 1).otherwise(0)).alias("b"))
    spans = runs.select("conv", "part", F.coalesce(F.sum("o").over(one), F.lit(0)).alias("before"), F.sum("b").over(two).alias("led"), F.sum("o").over(two).alias("own"), F.count(F.lit(1)).over(two).alias("parts"))
    # Two neighbouring parts share one conversation at most, so this has no more than two rows a part.
    carry = stored(spans.where("parts > 1").drop("parts"), "trie-carry")
    inside = placed(rows.join(F.broadcast(carry.select("conv", "part")), ["conv", "part"], "left_semi"), carry)
    sums = inside.groupBy("conv", "part").agg(*[F.sum(c).alias(c) for c in LANES])
    sums = stored(sums.select("conv", "part", *[F.coalesce(F.sum(c).over(one), F.lit(0)).alias(f"c{c}") for c in LANES]), "trie-sums")
    upto = Window.partitionBy("part", "conv").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = placed(rows, carry).join(F.broadcast(sums), ["conv", "part"], "left")
    found = found.select("conv", "pos", "n", "whole", *LANES, *[(F.coalesce(f"c{c}", F.lit(0)) + F.sum(c).over(upto)).alias(f"s{c}") for c in LANES])

    def key(a: str, b: str, name: str) -> F.Column:
        return F.expr(f"({a} & {LOW}L) | shiftleft(({b}) & {LOW}L, 32)").alias(name)

    pairs = (("l0", "l1"), ("l2", "l3"))
    return found.select("conv", "pos", "n", "whole", *[key(f"s{a}", f"s{b}", f"k{i}") for i, (a, b) in enumerate(pairs, 1)], *[key(f"(s{a} - {a})", f"s{b} - {b}", f"p{i}") for i, (a, b) in enumerate(pairs, 1)])


class Louds:
    """A forest in level order: the bitvector, and where the nodes of the arrays it was made from are in that order.

    Node 0 is above the roots. The bits have a 1 for every child and a 0 after the last, node after node.
    """

    def __init__(self, levels: np.ndarray, keys: list[tuple], parents: list[tuple]) -> None:
        """levels: of each node, 0 for roots, whose parents' keys don't count."""
        place = {k: i for i, k in enumerate(keys)}
        above = np.array([place.get(p, -1) for p in parents], np.int64)
        above[levels == 0] = -1
        number = np.zeros(len(keys), np.int64)
        by_level = np.argsort(levels, kind="stable")
        cuts = np.searchsorted(levels[by_level], np.arange(int(levels.max(initial=-1)) + 2))
        parent_of: list[np.ndarray] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            up = np.where(above[by_level[a:b]] < 0, 0, number[above[by_level[a:b]]])
            order = np.argsort(up, kind="stable")
            by_level[a:b] = by_level[a:b][order]
            number[by_level[a:b]] = 1 + np.arange(a, b)
            parent_of.append(up[order])
        degrees = np.bincount(np.concatenate(parent_of) if parent_of else np.zeros(0, np.int64), minlength=len(keys) + 1)
        bits = np.ones(int(degrees.sum()) + len(degrees), bool)
        bits[np.cumsum(degrees + 1) - 1] = False
        self.bits, self.size, self.order, self.cuts = np.packbits(bits), len(bits), by_level, 1 + cuts

    def parents(self) -> np.ndarray:
        """The parent of every node from 1 on: the number of zeros before its one (rank of select)."""
        ones = np.flatnonzero(np.unpackbits(self.bits, count=self.size))
        return ones - np.arange(len(ones))

    def degrees(self) -> np.ndarray:
        """The number of children of every node, the one above the roots included."""
        return np.diff(np.flatnonzero(np.unpackbits(self.bits, count=self.size) == 0), prepend=-1) - 1

    def rolled_up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees, by levels from the last; values has a number for each node, 0 for the one above the roots."""
        out, parents = values.copy(), self.parents()
        for a, b in zip(self.cuts[-2::-1], self.cuts[:0:-1], strict=True):
            np.add.at(out, parents[a - 1 : b - 1], out[a:b])
        return out


NODE = "pos long, k1 long, k2 long, p1 long, p2 long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, top boolean"


def forest(rows: pa.Table) -> pa.RecordBatch:
    """Nodes of whole shards with parents and rollups."""
    col = {c: rows[c].to_numpy() for c in ("pos", "cut", "k1", "k2", "p1", "p2", "owner", "n_convs", "n")}
    levels = col["pos"] - col["cut"]
    trie = Louds(levels, list(zip(col["k1"].tolist(), col["k2"].tolist(), strict=True)), list(zip(col["p1"].tolist(), col["p2"].tolist(), strict=True)))
    col = {c: v[trie.order] for c, v in col.items()}
    levels, degrees, parents = levels[trie.order], trie.degrees()[1:], trie.parents()
    leaves = trie.rolled_up(np.append(0, (degrees == 0).astype(np.int64)))[1:]
    saved = trie.rolled_up(np.append(0, (col["n_convs"] - 1) * col["n"]))[1:]
    owner = np.append(-1, col["owner"])[parents]
    top = levels == 0
    return pa.RecordBatch.from_arrays([*[pa.array(col[c]) for c in ("pos", "k1", "k2", "p1", "p2", "owner")], pa.array(owner, mask=top), *map(pa.array, (col["n_convs"], degrees, leaves, saved, top))], names=[x.split()[0] for x in NODE.split(", ")])


def sharded(light: DataFrame) -> DataFrame:
    """The nodes of the light subtrees (NODE), each subtree whole in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) < FOREST:
                continue
            rows = pa.Table.from_batches(held)
            s1, s2 = rows["s1"].to_numpy(), rows["s2"].to_numpy()
            ends = np.flatnonzero((s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])) + 1
            if len(ends):
                yield forest(rows.slice(0, int(ends[-1])))
                held = rows.slice(int(ends[-1])).to_batches()
        if held:
            yield forest(pa.Table.from_batches(held))

    return light.repartition("s1", "s2").sortWithinPartitions("s1", "s2").mapInArrow(run, NODE)


def marked(rows: DataFrame, heavy: DataFrame, total: int) -> DataFrame:
    """conv, pos, k1, k2 and whether the node is heavy. Nodes of over a thousandth of all rows are broadcast, fewer than 1,000 at a depth."""
    yes = [*KEY, F.lit(True).alias("heavy")]
    large = F.col("n_convs") * 1000 > total
    near = rows.select("conv", *KEY).join(F.broadcast(heavy.where(large).select(*yes)), KEY, "left")
    far = near.where("heavy is null").drop("heavy").join(heavy.where(~large).select(*yes).hint("merge"), KEY, "left")
    return near.where("heavy").unionByName(far.select(*near.columns))


def shards(rows: DataFrame, nodes: DataFrame, heavy: DataFrame) -> DataFrame:
    """Light nodes with the depth (cut) and key (s1, s2) of their subtree's first node."""
    below = heavy.where("pos > 0")
    if below.isEmpty():
        first = rows.where("pos = 1").select("conv", F.struct(*KEY).alias("f"))
    else:
        found = marked(rows.where("pos > 0"), below, rows.count())
        first = found.where("heavy is null").groupBy("conv").agg(F.min_by(F.struct(*KEY), "pos").alias("f"))
    cut = first.select(F.col("conv").alias("owner"), F.col("f.pos").alias("cut"), F.col("f.k1").alias("s1"), F.col("f.k2").alias("s2"))
    return nodes.where("not heavy").join(cut.hint("merge"), "owner")


def upper(heavy: DataFrame, tops: DataFrame) -> DataFrame:
    """Heavy nodes (NODE): their own values, those of the shards below, and what goes up between them."""
    up = [(F.col("pos") - 1).alias("pos"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    below = tops.groupBy(*up).agg(F.count(F.lit(1)).alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
    inner = heavy.where("pos > 0").groupBy(*up).agg(F.count(F.lit(1)).alias("i"))
    nodes = heavy.join(below, KEY, "left").join(inner, KEY, "left").fillna(0, ["c", "l", "s", "i"])
    leaf = F.when(F.col("c") + F.col("i") == 0, 1).otherwise(0)
    nodes = stored(nodes.select(*KEY, "p1", "p2", "owner", "n_convs", (F.col("c") + F.col("i")).alias("n_children"), (F.col("l") + leaf).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n") + F.col("s")).alias("saved")), "trie-upper")
    depth = nodes.agg(F.max("pos")).first()[0] or 0
    # In each round a node has the sums of the levels down to `step`, and the key of the node `step` levels up.
    sums, step = nodes.select(*KEY, "p1", "p2", "n_leaves", "saved"), 1
    while step <= depth:
        more = sums.where(F.col("pos") >= step).groupBy((F.col("pos") - step).alias("pos"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
        next_up = sums.where(F.col("pos") >= step).select((F.col("pos") + step).alias("pos"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("p1").alias("q1"), F.col("p2").alias("q2"))
        sums = sums.join(more, KEY, "left").join(next_up, ["pos", "p1", "p2"], "left")
        sums = stored(sums.select(*KEY, F.coalesce("q1", F.lit(0)).alias("p1"), F.coalesce("q2", F.lit(0)).alias("p2"), (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")), "trie-upper")
        step *= 2
    return nodes.drop("n_leaves", "saved").join(sums.drop("p1", "p2"), KEY)


def parented(nodes: DataFrame, heavy: DataFrame) -> DataFrame:
    """nodes with p1, p2 and pos, whose parents are heavy, with the parent's conversation. Parents of over a thousandth of them are broadcast."""
    counts = nodes.groupBy((F.col("pos") - 1).alias("pos"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("m"))
    named = heavy.select(*KEY, F.col("owner").alias("parent_conv_id")).join(counts, KEY).select((F.col("pos") + 1).alias("pos"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), "parent_conv_id", "m")
    large, on = F.col("m") * 1000 > nodes.count(), ["pos", "p1", "p2"]
    near = nodes.drop("parent_conv_id").join(F.broadcast(named.where(large).drop("m")), on, "left")
    far = near.where("parent_conv_id is null").drop("parent_conv_id").join(named.where(~large).drop("m").hint("merge"), on, "left")
    return near.where("parent_conv_id is not null").unionByName(far.select(*near.columns))


def ends(rows: DataFrame) -> DataFrame:
    """KEY and ends_sha256 of the nodes where conversations end. Ids go out in pieces, so one node's task reads few rows, and holds one piece."""

    def pieces_of(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        cols = [batch.column(k).to_numpy() for k in range(4)]
        change = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])) + 1
        at = np.union1d(np.append(0, change), np.arange(0, batch.num_rows, PIECE))
        ids = cols[3].astype(str).tolist()
        text = [",".join(ids[a:b]) for a, b in zip(at, np.append(at[1:], batch.num_rows), strict=True)]
        return pa.RecordBatch.from_arrays([*[pa.array(c[at]) for c in cols], pa.array(text)], names=[*KEY, "first", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha = None, None
        for batch in batches:
            out = []
            for pos, k1, k2, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                if (pos, k1, k2) == last:
                    sha.update(b"," + ids.encode())
                else:
                    if last:
                        out.append((*last, sha.hexdigest()))
                    last, sha = (pos, k1, k2), hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=[*KEY, "ends_sha256"])
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*last, sha.hexdigest())], names=[*KEY, "ends_sha256"])

    last = rows.where("pos = whole").select(*KEY, "conv").repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv")
    cut = map_batches(last, lambda b: pieces_of(b) if b.num_rows else None, "pos long, k1 long, k2 long, first long, ids string")
    return cut.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(run, "pos long, k1 long, k2 long, ends_sha256 string")


def nodes(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the rebuilt conversations.

    A conversation c takes its first h = crc32(c) % 6 turns from conversation c - c % 100 (all if that has fewer, none if there is
    none) and goes on with its own turns after the first h. Turns are ordered by turn, nulls first, equal ones by role and then
    by a digest of their text; repeated rows are turns of their own. A null role or text is empty. Rows whose conversation is null
    are left out, other columns are not read, and an empty table has no node. Texts may be of any length: they are read once
    and stay where they are.
    """
    prepare(turns.sparkSession)
    rows = stored(prefixes(sequences(turns_of(turns, conv_col, turn_col, role_col, text_col))), "trie-rows")
    found = rows.groupBy(*KEY).agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("n").alias("n"), F.sum(F.col("whole") - F.col("pos") + 1).alias("rows"))
    found = stored(found.withColumn("heavy", (F.col("rows") > shard) | (F.col("pos") == 0)), "trie-nodes")
    heavy = found.where("heavy")
    light = stored(sharded(shards(rows, found, heavy)), "trie-shards")
    tops = light.where("top")
    over = upper(heavy, tops).withColumn("conv_id", F.col("owner"))
    shared = ["pos", "k1", "k2", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved"]
    rest = tops.select(*KEY, "p1", "p2", "conv_id", "n_convs", "n_children", "n_leaves", "saved").unionByName(over.where("pos > 0").select(*KEY, "p1", "p2", "conv_id", "n_convs", "n_children", "n_leaves", "saved"))
    root = over.where("pos = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    whole = light.where("not top").select(*shared).unionByName(parented(rest, heavy).select(*shared)).unionByName(root.select(*shared))
    found = whole.join(ends(rows), KEY, "left")
    return found.select("conv_id", F.col("pos").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
