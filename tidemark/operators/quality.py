"""Extraction quality: coverage, daily statistics, comparison of runs, evaluation, gates, samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def daily(rows: DataFrame) -> DataFrame:
    """By day and field over numeric values: count, mean (four digits), least, greatest, distinct documents."""
    return rows.where(F.col("value_num").isNotNull()).groupBy("day", "field").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value_num"), 4).alias("mean"), F.min("value_num").alias("least"), F.max("value_num").alias("greatest"), F.countDistinct("accession").alias("docs"))


def coverage(rows: DataFrame) -> DataFrame:
    """By field: attempts, values got, located, absent flags, documents, and rates over attempts less absences."""
    out = rows.groupBy("field").agg(F.count(F.lit(1)).alias("attempts"), F.count("value_num").alias("got"), F.count("span_start").alias("located"), F.count_if(F.col("flag").ilike("%unlocatable%")).alias("absent"), F.countDistinct("accession").alias("docs"))
    applicable = F.greatest(F.lit(0), F.col("attempts") - F.col("absent"))
    return out.withColumns({"got_rate": F.round(ratio(F.col("got"), applicable), 4), "located_rate": F.round(ratio(F.col("located"), applicable), 4)})


def field_stats(rows: DataFrame, run: str) -> DataFrame:
    """Of one run by field: rows, present, spanned, distinct values, flagged."""
    return rows.where(F.col("run_id") == run).groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count("value_num").alias("present"), F.count("span_start").alias("spanned"), F.countDistinct("value_num").alias("distinct_values"), F.count("flag").alias("flagged"))


def dominant(rows: DataFrame, least: float = 0.6) -> DataFrame:
    """By field the most common value (the least of equal ones), its share of all rows and whether that reaches `least`."""
    counts = rows.groupBy("field", "value_num").agg(F.count(F.lit(1)).alias("c"))
    best = counts.groupBy("field").agg(F.sum("c").alias("n"), F.max(F.when(F.col("value_num").isNotNull(), F.struct("c", (-F.col("value_num")).alias("v")))).alias("b"))
    return best.select("field", (-F.col("b.v")).alias("value_num"), F.round(ratio(F.col("b.c"), F.col("n")), 4).alias("share"), (F.coalesce(ratio(F.col("b.c"), F.col("n")), F.lit(0.0)) >= least).alias("dominated"))


def comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs' field statistics side by side; a field that one lacks counts 0 there."""
    cols = [c for c in a.columns if c != "field"]
    both = a.select("field", *[F.col(c).alias(f"{c}_a") for c in cols]).join(b.select("field", *[F.col(c).alias(f"{c}_b") for c in cols]), "field", "full")
    return both.select("field", *[F.coalesce(x, F.lit(0)).alias(x) for c in cols for x in (f"{c}_a", f"{c}_b")])


def values_by_run(rows: DataFrame, field: str, runs: Sequence[str]) -> DataFrame:
    """Counts of a field's values in each run and in all."""
    own = rows.where(F.col("field") == field)
    return own.groupBy("value_num").agg(*[F.count_if(F.col("run_id") == r).alias(f"run_{k}") for k, r in enumerate(runs)], F.count(F.lit(1)).alias("total"))


def confusion(rows: DataFrame) -> DataFrame:
    """By field: tp, fp, fn, tn of predictions against gold (nulls are absences), precision, recall, absence false positives."""
    p, g = F.col("pred").isNotNull(), F.col("gold").isNotNull()
    same = F.coalesce(F.col("pred") == F.col("gold"), F.lit(False))
    out = rows.groupBy("field").agg(F.count_if(p & g & same).alias("tp"), F.count_if(p & (~g | ~same)).alias("fp"), F.count_if(g & (~p | ~same)).alias("fn"), F.count_if(~p & ~g).alias("tn"), F.count_if(p & ~g).alias("absence_fp"), F.count_if(~g).alias("absent"))
    return out.withColumns({"precision": F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6), "recall": F.round(ratio(F.col("tp"), F.col("tp") + F.col("fn")), 6), "absence_fp_rate": F.round(ratio(F.col("absence_fp"), F.col("absent")), 6)})


def gate(base: DataFrame, candidate: DataFrame, drops: Mapping[str, float], support: int = 5) -> DataFrame:
    """By field and metric: delta, and blocked where it falls by more than allowed, given the support; a missing field blocks."""
    def long(d: DataFrame, name: str) -> DataFrame:
        return d.select("field", (F.col("tp") + F.col("fn")).alias(f"n_{name}"), F.explode(F.create_map(*[x for m in drops for x in (F.lit(m), F.col(m))])).alias("metric", name))

    both = long(base, "base").join(long(candidate, "cand"), ["field", "metric"], "left")
    allowed = F.element_at(F.create_map(*[x for m, d in drops.items() for x in (F.lit(m), F.lit(d))]), F.col("metric"))
    delta = F.col("cand") - F.col("base")
    blocked = F.when(F.col("n_cand").isNull(), True).when(F.col("n_base") < support, False).otherwise(F.coalesce(delta < -allowed, F.lit(False)))
    return both.select("field", "metric", F.round(delta, 6).alias("delta"), blocked.alias("blocked"))


def stratified(rows: DataFrame, stratum: str, key: str, least: int, total: int, seed: str = "") -> DataFrame:
    """At least `least` rows of each stratum, then one of each in turn up to `total`, in a seeded order."""
    order = F.xxhash64(F.lit(seed), F.col(key))
    placed = rows.withColumn("rn", F.row_number().over(W.Window.partitionBy(stratum).orderBy(order, key)))
    return placed.orderBy(F.when(F.col("rn") <= least, 0).otherwise(1), "rn", stratum).limit(total)


def tallies(verdicts: DataFrame, fields: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Counts of verdicts by field, also of fields without any."""
    counts = verdicts.groupBy("field").agg(*[F.count_if(F.col("verdict") == k).alias(k) for k in kinds])
    return fields.select("field").distinct().join(counts, "field", "left").select("field", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])


def fatigue(rows: DataFrame) -> DataFrame:
    """By session the accept rate of the second half of its rows less that of the first floor(n/2)."""
    w = W.Window.partitionBy("session")
    half = F.row_number().over(w.orderBy("seq")) <= F.floor(F.count(F.lit(1)).over(w) / 2)
    return rows.withColumn("first", half).groupBy("session").agg((F.avg(F.when(~F.col("first"), F.col("accept").cast("int"))) - F.avg(F.when(F.col("first"), F.col("accept").cast("int")))).alias("delta"))


def timing(rows: DataFrame) -> DataFrame:
    """Median and mean of the documents' spans between first and last time; documents with one time have none."""
    spans = rows.groupBy("doc").agg((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("d")).where("d > 0")
    return spans.agg(F.round(F.percentile("d", 0.5) / 1e6, 3).alias("median_s"), F.round(F.avg("d") / 1e6, 3).alias("mean_s"), F.count(F.lit(1)).alias("docs"))


def modal_anchor(rows: DataFrame, decided: DataFrame, support: int = 3, majority: float = 0.5) -> DataFrame:
    """By (issuer, field) the most common anchor with enough rows and share, of pairs not decided before."""
    counts = rows.join(decided, ["issuer", "field"], "left_anti").groupBy("issuer", "field", "anchor").agg(F.count(F.lit(1)).alias("c"))
    best = counts.groupBy("issuer", "field").agg(F.sum("c").alias("n"), F.max_by(F.struct("anchor", "c"), F.struct("c", "anchor")).alias("b"))
    return best.where((F.col("b.c") >= support) & (F.col("b.c") / F.col("n") >= majority)).select("issuer", "field", "b.anchor", "b.c")


def issuance(docs: DataFrame, top: int = 8) -> DataFrame:
    """(month, name, amount): a document's amount split evenly over its names; the `top` names by total stay, others are Other."""
    rows = docs.where(F.size("names") > 0).withColumn("name", F.explode("names")).withColumn("part", F.col("amount") / F.size("names"))
    sums = rows.groupBy("month", "name").agg(F.sum("part").alias("amount"))
    # A total for each name, of which `top` are kept: the list that is broadcast has that many rows.
    best = sums.groupBy("name").agg(F.sum("amount").alias("t")).orderBy(F.desc("t"), "name").limit(top).select("name", F.lit(True).alias("own"))
    folded = sums.join(F.broadcast(best), "name", "left").withColumn("name", F.when(F.col("own"), F.col("name").cast("string")).otherwise("Other"))
    return folded.groupBy("month", "name").agg(F.sum("amount").alias("amount")).where("name <> 'Other' or amount <> 0")


def buckets(rows: DataFrame, columns: Sequence[str], width: float = 5.0) -> DataFrame:
    """(kind, bucket, n): the columns' absolute values in buckets of the width, halves to the even one."""
    long = rows.unpivot([], list(columns), "kind", "v").where(F.col("v").isNotNull())
    return long.groupBy("kind", (F.bround(F.abs("v") / width) * width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def league(rows: DataFrame) -> DataFrame:
    """By issuer and type: mean markup, total principal, first and last month, the highest mean first."""
    return rows.groupBy("issuer", "product_type").agg(F.round(F.avg("markup"), 6).alias("markup"), F.sum("principal").alias("principal"), F.min("month").alias("first"), F.max("month").alias("last"))


def shares(rows: DataFrame, column: str, kinds: Sequence[str]) -> DataFrame:
    """Each kind's share of all rows, 0 for one without any."""
    counts = rows.agg(*[F.count_if(F.col(column) == k).alias(k) for k in kinds], F.count(F.lit(1)).alias("__n"))
    return counts.select(F.explode(F.create_map(*[x for k in kinds for x in (F.lit(k), F.round(ratio(F.col(k), F.col("__n")), 4))])).alias("kind", "share"))


def per_day_sample(rows: DataFrame, k: int, days: int, day: str = "day", order: str = "id") -> DataFrame:
    """k rows of each of the last `days` weekdays that have any."""
    week = rows.where(F.weekday(day) < 5)
    last = week.select(day).distinct().orderBy(F.desc(day)).limit(days)
    own = week.join(F.broadcast(last), day, "left_semi")
    return own.withColumn("rn", F.row_number().over(W.Window.partitionBy(day).orderBy(order))).where(F.col("rn") <= k)


def top_up(rows: DataFrame, tried: DataFrame, keys: Sequence[str], order: str, k: int, stride: int = 7919) -> DataFrame:
    """Up to k new rows of each key in the order (stride * i mod n, i), rows tried before left out."""
    w = W.Window.partitionBy(*keys)
    placed = rows.withColumn("i", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("slot", F.pmod(F.col("i") * stride, F.col("n")))
    fresh = placed.join(tried.select(order), order, "left_anti")
    return fresh.withColumn("rn", F.row_number().over(w.orderBy("slot", "i"))).where(F.col("rn") <= k)


def exemplars(rows: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """k examples a key: corrections before accepts, one for each (anchor, type), one place kept for a rejection."""
    w = W.Window.partitionBy(*keys, "anchor", "kind")
    rank = F.when(F.col("verdict") == "correct", 0).when(F.col("verdict") == "accept", 1)
    good = rows.withColumn("r", rank).where("r is not null").withColumn("d", F.row_number().over(w.orderBy("r", "seq"))).where("d = 1")
    good = good.withColumn("place", F.row_number().over(W.Window.partitionBy(*keys).orderBy("r", "seq")))
    bad = rows.where("verdict = 'reject'").withColumn("place", F.row_number().over(W.Window.partitionBy(*keys).orderBy("seq"))).where("place = 1")
    has_bad = bad.select(*keys, F.lit(1).alias("taken"))
    kept = good.join(has_bad, list(keys), "left").where(F.col("place") <= k - F.coalesce("taken", F.lit(0)))
    return kept.select(*rows.columns).unionByName(bad.select(*rows.columns))
