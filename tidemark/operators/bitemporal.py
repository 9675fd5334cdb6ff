"""Facts with restatements: each key has versions, known from the day they were filed.

Facts have cik, concept, period_start, period_end, accession, value, filed (null: never visible as of a day) and ingested_seq. The
latest version of a key is the one with the greatest (accession, ingested_seq), whatever the day it was filed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

KEY = ("cik", "concept", "period_start", "period_end")


#: Runs that values are cut in for a ranking.
RUNS = 64


def last_of(rows: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The row of each key that is greatest by the order columns (nulls least); one aggregation, no sort of all rows."""
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("__r"))
    return best.select(*keys, "__r.*").select(*rows.columns)


def upsert(stored: DataFrame, new: DataFrame, keys: Sequence[str] = (*KEY, "accession"), seq: str = "ingested_seq") -> DataFrame:
    """stored with new rows in the place of rows with the same key; a replaced row takes the new row's place in ingestion."""
    return last_of(stored.unionByName(new, allowMissingColumns=True), keys, seq)


def upsert_names(stored: DataFrame, new: DataFrame, key: str = "cik", name: str = "name", seq: str = "seq") -> DataFrame:
    """Names by key; an empty name never replaces one."""
    return last_of(stored.unionByName(new).where(F.trim(F.coalesce(name, F.lit(""))) != ""), [key], seq)


def canonical_cik(cik: Column) -> Column:
    """Digits only, ten places."""
    return F.lpad(F.regexp_replace(cik, r"\D", ""), 10, "0")


def canonical_rows(rows: DataFrame, keys: Sequence[str], column: str = "cik", seq: str = "ingested_seq") -> DataFrame:
    """Rows under canonical identifiers; where two collide the row that already was canonical stays, else the later."""
    marked = rows.withColumn("__own", (F.col(column) == canonical_cik(F.col(column))).cast("int")).withColumn(column, canonical_cik(F.col(column)))
    return last_of(marked, keys, "__own", seq).drop("__own")


def latest(facts: DataFrame) -> DataFrame:
    return last_of(facts, KEY, "accession", "ingested_seq")


def as_of(facts: DataFrame, day: str) -> DataFrame:
    """The latest version of each key among those filed by the day."""
    return latest(facts.where(F.col("filed") <= day))


def as_of_collapsed(facts: DataFrame, day: str) -> tuple[DataFrame, DataFrame]:
    """(known, dropped): keys whose latest version has a filing day are taken as of the day; the others are dropped.

    dropped has their number by cik. A key whose latest version was never filed is dropped though an older one was.
    """
    last = latest(facts)
    dated = last.where(F.col("filed").isNotNull()).select(*KEY)
    return as_of(facts.join(dated, list(KEY), "left_semi"), day), last.groupBy("cik").agg(F.count_if(F.col("filed").isNull()).alias("dropped"))


def history(facts: DataFrame) -> DataFrame:
    """All versions with their number in each key, the oldest first."""
    return facts.withColumn("version", F.row_number().over(W.Window.partitionBy(*KEY).orderBy("accession", "ingested_seq")))


def by_priority(facts: DataFrame, concepts: Mapping[str, Sequence[str]], keys: Sequence[str] = ("cik", "period_start", "period_end")) -> DataFrame:
    """One row for each key and field: the fact of the first concept in the field's list that the key has."""
    pairs = [F.struct(F.lit(f).alias("field"), F.lit(c).alias("concept"), F.lit(i).alias("rank")) for f, own in concepts.items() for i, c in enumerate(own)]
    named = facts.withColumn("__p", F.explode(F.filter(F.array(*pairs), lambda p: p["concept"] == F.col("concept")))).select("*", F.col("__p.field").alias("field"), F.col("__p.rank").alias("rank")).drop("__p")
    best = named.groupBy(*keys, "field").agg(F.min_by(F.struct(*[c for c in facts.columns if c not in keys], "rank"), F.struct("rank")).alias("r"))
    return best.select(*keys, "field", "r.*")


def difference(resolved: DataFrame, name: str, whole: str, part: str, keys: Sequence[str] = ("cik", "period_start", "period_end")) -> DataFrame:
    """whole less part as a field of its own; none if a side is missing, both are one concept or it would be negative."""
    own = lambda f: F.max(F.when(F.col("field") == f, F.struct("value", "concept")))
    both = resolved.where(F.col("field").isin(whole, part)).groupBy(*keys).agg(own(whole).alias("a"), own(part).alias("b"))
    return both.where((F.col("a.concept") != F.col("b.concept")) & (F.col("a.value") >= F.col("b.value"))).select(*keys, F.lit(name).alias("field"), (F.col("a.value") - F.col("b.value")).alias("value"))


def duration_days(start: str = "period_start", end: str = "period_end") -> Column:
    return F.datediff(F.to_date(end), F.to_date(start))


def duration_class(days: Column) -> Column:
    """At most 100 days: quarterly (so is an instant); 300 to 380: annual; else other."""
    return F.when(days <= 100, "quarterly").when(days.between(300, 380), "annual").otherwise("other")


def one_per_year(annual: DataFrame) -> DataFrame:
    """One annual fact for each fiscal year: the one that ends last."""
    return last_of(annual, ["cik", "concept", "fiscal_year"], "period_end", "accession")


def change(rows: DataFrame, kind: str, keys: Sequence[str] = ("cik",)) -> DataFrame:
    """rows with prior, pct and reason against the period before; kind is year or quarter.

    The reason why there is no per cent, in this order: no prior period; a gap (fiscal years not in sequence, or more
    than 20 days or an overlap between quarters); a value that is null; a prior of zero; a negative prior.
    """
    w = W.Window.partitionBy(*keys).orderBy("period_end")
    before = F.lag("value").over(w)
    gap = (F.year("period_end") - F.year(F.lag("period_end").over(w)) != 1) if kind == "year" else ~F.datediff("period_start", F.lag("period_end").over(w)).between(0, 20)
    exists = F.lag(F.lit(1)).over(w).isNotNull()
    reason = F.when(~exists, "no_prior").when(gap, "gap").when(F.col("value").isNull() | before.isNull(), "not_numeric").when(before == 0, "zero_base").when(before < 0, "negative_base")
    out = rows.withColumns({"prior": before, "reason": reason})
    return out.withColumn("pct", F.when(F.col("reason").isNull(), (F.col("value") - F.col("prior")) / F.col("prior") * 100))


def fourth_quarters(quarters: DataFrame, annual: DataFrame) -> DataFrame:
    """(cik, period_start, period_end, value) of the last quarter where exactly three lie inside the year.

    Quarters join the years that may contain them on cik and the calendar year of their start, then by the interval.
    """
    q = quarters.select("cik", F.col("period_start").alias("qs"), F.col("period_end").alias("qe"), F.col("value").alias("qv"), F.year("period_start").alias("__y"))
    spread = annual.withColumn("__y", F.explode(F.sequence(F.year("period_start"), F.year("period_end"))))
    inside = spread.join(q, ["cik", "__y"]).where((F.col("qs") >= F.col("period_start")) & (F.col("qe") <= F.col("period_end")))
    found = inside.groupBy("cik", "period_start", "period_end", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("qv").alias("known"), F.max("qe").alias("last"))
    return found.where("n = 3").select("cik", F.date_add(F.to_date("last"), 1).alias("period_start"), "period_end", (F.col("value") - F.col("known")).alias("value"))


def rollups(values: DataFrame, arcs: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """For each (cik, parent) with all children known: expected, actual, ok and the ordered children.

    values: (cik, concept, value); arcs: (cik, parent, child, weight, ord). ok: within the tolerance of the actual value.
    """
    child = values.select("cik", F.col("concept").alias("child"), F.col("value").alias("cv"))
    parent = values.select("cik", F.col("concept").alias("parent"), F.col("value").alias("actual"))
    sums = arcs.join(child, ["cik", "child"], "left").groupBy("cik", "parent").agg(F.sum(F.col("weight") * F.col("cv")).alias("expected"), F.count_if(F.col("cv").isNull()).alias("missing"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "child"))), lambda x: x["child"]).alias("children"))
    found = sums.where("missing = 0").join(parent, ["cik", "parent"])
    return found.select("cik", "parent", "expected", "actual", (F.abs(F.col("expected") - F.col("actual")) <= tolerance * F.abs("actual")).alias("ok"), "children")


def restated(facts: DataFrame) -> DataFrame:
    """Keys with more than one value."""
    return facts.groupBy(*KEY).agg(F.countDistinct("value").alias("n_values")).where("n_values > 1")


def filers(facts: DataFrame) -> DataFrame:
    """By cik: rows, distinct filings, concepts in order and the span of periods."""
    return facts.groupBy("cik").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("accession").alias("filings"), F.concat_ws(",", F.array_sort(F.collect_set("concept"))).alias("concepts"), F.min("period_end").alias("first"), F.max("period_end").alias("last"))


def in_force(guidance: DataFrame, actual: DataFrame) -> DataFrame:
    """Guidance against the actual of its (cik, metric, label): the last one filed by the year of the close, else the last.

    guidance: cik, metric, label, year, low, high; actual: cik, metric, label, close_year, value. Adds midpoint, verdict (beat, miss or
    in_range) and surprise (per cent of the midpoint, null where it isn't positive).
    """
    both = guidance.join(actual, ["cik", "metric", "label"])
    early = F.max_by(F.struct("low", "high", "year"), F.when(F.col("year") <= F.col("close_year"), F.struct("year", "seq")))
    late = F.max_by(F.struct("low", "high", "year"), F.struct("year", "seq"))
    picked = both.groupBy("cik", "metric", "label", "value").agg(F.coalesce(early, late).alias("g")).select("cik", "metric", "label", "value", "g.*")
    mid = F.when(F.col("low").isNotNull() & F.col("high").isNotNull(), (F.col("low") + F.col("high")) / 2).otherwise(F.coalesce("low", "high"))
    out = picked.withColumn("midpoint", mid)
    verdict = F.when(F.col("value") > F.coalesce("high", "low"), "beat").when(F.col("value") < F.coalesce("low", "high"), "miss").otherwise("in_range")
    return out.withColumns({"verdict": verdict, "surprise": F.when(F.col("midpoint") > 0, (F.col("value") - F.col("midpoint")) / F.col("midpoint") * 100)})


def ranked(resolved: DataFrame, field: str, start: str, end: str) -> DataFrame:
    """Filers by a field's value in the last period that ends in [start, end), the greatest first, nulls last."""
    rows = resolved.where((F.col("field") == field) & (F.col("period_end") >= start) & (F.col("period_end") < end))
    last = last_of(rows.select("cik", "period_end", "value", "accession"), ["cik"], "period_end", "accession")
    # Values are cut at quantiles, so no task ranks all filers; a run's first rank follows from the counts of the runs above.
    bounds = last.agg(F.percentile_approx("value", [k / RUNS for k in range(1, RUNS)], 10_000).alias("q")).first()["q"] or []
    run = sum(((F.col("value") < b).cast("int") for b in sorted({float(b) for b in bounds})), F.lit(0))
    cut = last.withColumn("__run", F.when(F.col("value").isNull(), RUNS).otherwise(run))
    before, counts = {}, {r["__run"]: r["count"] for r in cut.groupBy("__run").count().collect()}
    for k in sorted(counts):
        before[k] = sum(n for r, n in counts.items() if r < k)
    first = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    own = F.rank().over(W.Window.partitionBy("__run").orderBy(F.desc_nulls_last("value")))
    return cut.withColumn("rank", (own + F.element_at(first, F.col("__run"))).cast("int")).drop("__run")


def tracked(checks: DataFrame, needed: int = 3, days: int = 7) -> DataFrame:
    """checks (field, day, seq, agree) with n, status and shadow after each.

    n counts agreements in a row. A field is `promoted` from the needed one on, however long the run took, `demoted` from a mismatch on until
    it is promoted again, and `pending` before either. A promoted field is shadowed for `days` days from the run's first agreement.
    Gaps and islands, one window a field.
    """
    w = W.Window.partitionBy("field").orderBy("seq")
    runs = checks.withColumn("__run", F.sum(F.when(F.col("agree"), 0).otherwise(1)).over(w))
    inside = W.Window.partitionBy("field", "__run").orderBy("seq")
    counted = runs.withColumn("n", F.sum(F.when(F.col("agree"), 1).otherwise(0)).over(inside).cast("int"))
    first = F.min(F.when(F.col("agree"), F.struct("seq", "day"))).over(inside)["day"]
    status = F.when(F.col("n") >= needed, "promoted").when(F.col("__run") > 0, "demoted").otherwise("pending")
    out = counted.withColumn("__first", first).withColumn("status", status)
    return out.withColumn("shadow", F.coalesce((F.col("status") == "promoted") & (F.datediff("day", "__first") <= days), F.lit(False))).drop("__run", "__first")


def agreements(checks: DataFrame, needed: int = 3) -> DataFrame:
    """(field, promoted): the day on which a field has first agreed `needed` times in a row, whatever the days between."""
    return tracked(checks, needed).where("status = 'promoted'").groupBy("field").agg(F.min("day").alias("promoted"))
