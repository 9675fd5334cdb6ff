"""Queries on facts with versions: latest, as of a day, history, changes, roll-ups, guidance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bitemporal as b
from tidemark.plans import stand_ins as s

FIELDS = {"revenue": ("F", "O"), "cost": ("P", "F"), "any": ("O", "F", "P")}
COLS = ("cik", "concept", "period_end", "accession", "value")


def scan2_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = s.facts(spark, sf_dir)
    new = f.where("ingested_seq % 5 = 0").withColumns({"value": F.col("value") + 1, "ingested_seq": F.col("ingested_seq") + 10_000_000})
    return b.upsert(f, new).select(*COLS, "ingested_seq")


def scan6_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = s.facts(spark, sf_dir).select("cik", "concept", "ingested_seq")
    raw = f.withColumn("cik", F.when(F.col("ingested_seq") % 2 == 0, F.concat(F.lit("CIK"), F.regexp_replace("cik", "^0+", ""))).otherwise(F.col("cik")))
    return b.canonical_rows(raw, ["cik", "concept"])


def win22_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.latest(s.facts(spark, sf_dir)).select(*COLS)


def join6_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.as_of(s.facts(spark, sf_dir), "1996-06-30").select(*COLS, "filed")


def filt9_as_of_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, dropped = b.as_of_collapsed(s.facts(spark, sf_dir), "1997-06-30")
    return dropped.join(known.groupBy("cik").agg(F.count(F.lit(1)).alias("known")), "cik", "left").select("cik", F.coalesce("known", F.lit(0)).alias("known"), "dropped")


def win23_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.history(s.facts(spark, sf_dir)).select(*COLS, "version")


def agg15_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.by_priority(b.latest(s.facts(spark, sf_dir)), FIELDS).select("cik", "period_end", "field", "concept", "value", "rank")


def agg16_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = b.difference(b.by_priority(b.latest(s.facts(spark, sf_dir)), FIELDS), "gross", "revenue", "cost")
    return out.select("cik", "period_end", "field", F.round("value", 4).alias("value"))


def agg18_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.one_per_year(s.facts(spark, sf_dir)).select(*COLS)


def _change(rows: DataFrame, kind: str) -> DataFrame:
    return b.change(rows, kind).select("cik", "period_end", "prior", "reason", F.round("pct", 6).alias("pct"))


def win25_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourth quarters against the year before's, those of nation and year divisible by five left out to make gaps."""
    return _change(s.quarters(spark, sf_dir).where("month(period_end) = 12 and (cik + year(period_end)) % 5 <> 0"), "year")


def win26_qoq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _change(s.quarters(spark, sf_dir).where("(cik + month(period_end)) % 7 <> 0"), "quarter")


def _annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = s.quarters(spark, sf_dir).withColumn("y", F.year("period_end"))
    return q.groupBy("cik", "y").agg(F.min("period_start").alias("period_start"), F.max("period_end").alias("period_end"), F.sum("value").alias("value")).drop("y")


def join17_fourth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.fourth_quarters(s.quarters(spark, sf_dir).where("month(period_end) < 12"), _annual(spark, sf_dir))


def agg19_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years as parents of their quarters."""
    q = s.quarters(spark, sf_dir).withColumns({"y": F.year("period_end").cast("string"), "k": F.concat(F.year("period_end"), F.lit("Q"), F.quarter("period_end"))})
    parents = q.groupBy("cik", F.col("y").alias("concept")).agg((F.sum("value") + F.when(F.col("cik") % 3 == 0, F.max("value")).otherwise(0)).alias("value"))
    values = q.select("cik", F.col("k").alias("concept"), "value").unionByName(parents)
    arcs = q.select("cik", F.col("y").alias("parent"), F.col("k").alias("child"), F.lit(1).alias("weight"), F.quarter("period_end").alias("ord"))
    out = b.rollups(values, arcs)
    return out.select("cik", "parent", "expected", "actual", "ok", F.concat_ws(",", "children").alias("children"))


def agg3_restated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.restated(s.facts(spark, sf_dir)).select("cik", "concept", "period_end", "n_values")


def agg3_filers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.filers(s.facts(spark, sf_dir))


def agg3_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts by year: versions in cells."""
    f = s.facts(spark, sf_dir)
    return f.groupBy("concept").pivot("fiscal_year", list(range(1992, 1999))).agg(F.count("value"))


def join14_guidance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of urgent priority as guidance for their customer's yearly fact."""
    f = b.latest(s.facts(spark, sf_dir))
    actual = f.select("cik", F.col("concept").alias("metric"), F.col("period_end").alias("label"), F.col("fiscal_year").alias("close_year"), "value")
    g = s.facts(spark, sf_dir).where("ingested_seq % 3 = 0").select("cik", F.col("concept").alias("metric"), F.col("period_end").alias("label"), (F.col("fiscal_year") + F.when(F.col("ingested_seq") % 2 == 0, 1).otherwise(0)).alias("year"), F.col("ingested_seq").alias("seq"), F.when(F.col("ingested_seq") % 4 != 0, F.col("value") * 0.9).alias("low"), (F.col("value") * 1.1).alias("high"))
    out = b.in_force(g, actual)
    return out.select("cik", "metric", "label", "value", F.round("midpoint", 4).alias("midpoint"), "verdict", F.round("surprise", 4).alias("surprise"))


def join24_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.ranked(b.by_priority(b.as_of(s.facts(spark, sf_dir), "1998-01-31"), FIELDS), "revenue", "1995-02-01", "1996-02-01")


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as checks: an agreement is a value over 10."""
    e = s.table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("field"), F.to_date("ts").alias("day"), F.col("event_id").alias("seq"), (F.coalesce("value", F.lit(0.0)) > 10).alias("agree"))


def strm4_agreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day of each user's first promotion, however long the run took."""
    return b.agreements(_checks(spark, sf_dir))


def strm5_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check with its user's run, status and whether the user is shadowed."""
    return b.tracked(_checks(spark, sf_dir)).select("field", "seq", "n", "status", "shadow")


QUERIES = {f.__name__: f for f in (scan2_upsert, scan6_canonical, win22_latest, join6_as_of, filt9_as_of_collapsed, win23_history, agg15_by_priority, agg16_difference, agg18_per_year, win25_yoy, win26_qoq, join17_fourth, agg19_rollups, agg3_restated, agg3_filers, agg3_grid, join14_guidance, join24_ranked, strm4_agreements, strm5_shadow)}

LATEST = f"{s.FACTS}, l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY cik, concept, period_end ORDER BY accession DESC, ingested_seq DESC) = 1)"
PRIORITY = """p(field, concept, rank) AS (VALUES ('revenue','F',0),('revenue','O',1),('cost','P',0),('cost','F',1),('any','O',0),('any','F',1),('any','P',2))"""


def _changes(where: str, gap: str) -> str:
    w = "OVER (PARTITION BY cik ORDER BY period_end)"
    return f"""WITH {s.QUARTERS}, r AS (SELECT *, lag(value) {w} AS prior, lag(period_end) {w} AS pe FROM q WHERE {where})
 SELECT cik, period_end, prior, CASE WHEN pe IS NULL THEN 'no_prior' WHEN {gap} THEN 'gap' WHEN prior = 0 THEN 'zero_base' WHEN prior < 0 THEN 'negative_base' END AS reason,
 CASE WHEN pe IS NOT NULL AND NOT ({gap}) AND prior > 0 THEN round((value - prior) / prior * 100, 6) END AS pct FROM r"""


#: Runs by mismatches so far; in a run the agreements count, and the first of them begins the shadow window.
CHECKS = """WITH e AS (SELECT user_id AS field, CAST(ts AS DATE) AS day, event_id AS seq, coalesce(value, 0) > 10 AS agree FROM events), r AS (SELECT *, sum(CASE WHEN agree THEN 0 ELSE 1 END) OVER (PARTITION BY field ORDER BY seq) AS run FROM e),
 c AS (SELECT *, CAST(count(*) FILTER (WHERE agree) OVER w AS INTEGER) AS n, min_by(day, seq) FILTER (WHERE agree) OVER w AS start FROM r WINDOW w AS (PARTITION BY field, run ORDER BY seq))"""
ORACLE_SQL = {
    "scan2_upsert": f"""WITH {s.FACTS}, u AS (SELECT * FROM f UNION ALL SELECT * REPLACE (value + 1 AS value, ingested_seq + 10000000 AS ingested_seq) FROM f WHERE ingested_seq % 5 = 0)
 SELECT cik, concept, period_end, accession, value, ingested_seq FROM u QUALIFY row_number() OVER (PARTITION BY cik, concept, period_start, period_end, accession ORDER BY ingested_seq DESC) = 1""",
    "scan6_canonical": f"""WITH {s.FACTS} SELECT cik, concept, ingested_seq FROM f QUALIFY row_number() OVER (PARTITION BY cik, concept ORDER BY ingested_seq % 2 DESC, ingested_seq DESC) = 1""",
    "win22_latest": f"WITH {LATEST} SELECT cik, concept, period_end, accession, value FROM l",
    "join6_as_of": f"""WITH {s.FACTS} SELECT cik, concept, period_end, accession, value, filed FROM f WHERE filed <= '1996-06-30' QUALIFY row_number() OVER (PARTITION BY cik, concept, period_end ORDER BY accession DESC, ingested_seq DESC) = 1""",
    "filt9_as_of_collapsed": f"""WITH {LATEST}, k AS (SELECT f.cik, f.concept, f.period_end FROM f JOIN l ON f.cik = l.cik AND f.concept = l.concept AND f.period_end = l.period_end WHERE l.filed IS NOT NULL AND f.filed <= '1997-06-30' GROUP BY 1, 2, 3),
 n AS (SELECT cik, count(*) AS known FROM k GROUP BY 1) SELECT l.cik, coalesce(any_value(known), 0) AS known, count(*) FILTER (WHERE filed IS NULL) AS dropped FROM l LEFT JOIN n USING (cik) GROUP BY l.cik""",
    "win23_history": f"WITH {s.FACTS} SELECT cik, concept, period_end, accession, value, row_number() OVER (PARTITION BY cik, concept, period_end ORDER BY accession, ingested_seq) AS version FROM f",
    "agg15_by_priority": f"WITH {LATEST}, {PRIORITY} SELECT cik, period_end, field, concept, value, rank FROM l JOIN p USING (concept) QUALIFY row_number() OVER (PARTITION BY cik, period_end, field ORDER BY rank) = 1",
    "agg16_difference": f"""WITH {LATEST}, {PRIORITY}, r AS (SELECT cik, period_end, field, concept, value FROM l JOIN p USING (concept) QUALIFY row_number() OVER (PARTITION BY cik, period_end, field ORDER BY rank) = 1)
 SELECT a.cik, a.period_end, 'gross' AS field, round(a.value - b.value, 4) AS value FROM r a JOIN r b ON a.cik = b.cik AND a.period_end = b.period_end AND a.field = 'revenue' AND b.field = 'cost' AND a.concept <> b.concept AND a.value >= b.value""",
    "agg18_per_year": f"WITH {s.FACTS} SELECT cik, concept, period_end, accession, value FROM f QUALIFY row_number() OVER (PARTITION BY cik, concept, fiscal_year ORDER BY period_end DESC, accession DESC) = 1",
    "win25_yoy": _changes("month(period_end) = 12 AND (cik + year(period_end)) % 5 <> 0", "year(period_end) - year(pe) <> 1"),
    "win26_qoq": _changes("(cik + month(period_end)) % 7 <> 0", "date_diff('day', pe, period_start) NOT BETWEEN 0 AND 20"),
    "join17_fourth": f"""WITH {s.QUARTERS}, a AS (SELECT cik, min(period_start) AS ps, max(period_end) AS pe, sum(value) AS v FROM q GROUP BY cik, year(period_end))
 SELECT a.cik, CAST(max(q.period_end) + INTERVAL 1 DAY AS DATE) AS period_start, a.pe AS period_end, a.v - sum(q.value) AS value FROM a JOIN q ON a.cik = q.cik AND q.period_start >= ps AND q.period_end <= pe AND month(q.period_end) < 12 GROUP BY a.cik, ps, pe, v HAVING count(*) = 3""",
    "agg19_rollups": f"""WITH {s.QUARTERS} SELECT cik, CAST(year(period_end) AS VARCHAR) AS parent, sum(value) AS expected, sum(value) + CASE WHEN cik % 3 = 0 THEN max(value) ELSE 0 END AS actual,
 CASE WHEN cik % 3 = 0 THEN max(value) ELSE 0 END <= 0.005 * abs(sum(value) + CASE WHEN cik % 3 = 0 THEN max(value) ELSE 0 END) AS ok, string_agg(year(period_end) || 'Q' || quarter(period_end), ',' ORDER BY period_end) AS children FROM q GROUP BY cik, year(period_end)""",
    "agg3_restated": f"WITH {s.FACTS} SELECT cik, concept, period_end, count(DISTINCT value) AS n_values FROM f GROUP BY 1, 2, 3 HAVING count(DISTINCT value) > 1",
    "agg3_filers": f"WITH {s.FACTS} SELECT cik, count(*) AS n, count(DISTINCT accession) AS filings, string_agg(DISTINCT concept, ',' ORDER BY concept) AS concepts, min(period_end) AS first, max(period_end) AS last FROM f GROUP BY 1",
    "agg3_grid": f"WITH {s.FACTS} SELECT concept, " + ", ".join(f'nullif(count(*) FILTER (WHERE fiscal_year = {y}), 0) AS "{y}"' for y in range(1992, 1999)) + " FROM f GROUP BY 1",
    "join14_guidance": f"""WITH {LATEST}, g AS (SELECT cik, concept, period_end, fiscal_year + CASE WHEN ingested_seq % 2 = 0 THEN 1 ELSE 0 END AS year, ingested_seq AS seq, CASE WHEN ingested_seq % 4 <> 0 THEN value * 0.9::DOUBLE END AS low, value * 1.1::DOUBLE AS high FROM f WHERE ingested_seq % 3 = 0),
 j AS (SELECT l.cik, l.concept, l.period_end, l.value, low, high FROM g JOIN l ON g.cik = l.cik AND g.concept = l.concept AND g.period_end = l.period_end QUALIFY row_number() OVER (PARTITION BY l.cik, l.concept, l.period_end ORDER BY year <= l.fiscal_year DESC, year DESC, seq DESC) = 1),
 m AS (SELECT *, CASE WHEN low IS NULL THEN high ELSE (low + high) / 2 END AS mid FROM j)
 SELECT cik, concept AS metric, period_end AS label, value, round(mid, 4) AS midpoint, CASE WHEN value > high THEN 'beat' WHEN value < coalesce(low, high) THEN 'miss' ELSE 'in_range' END AS verdict, CASE WHEN mid > 0 THEN round((value - mid) / mid * 100, 4) END AS surprise FROM m""",
    "join24_ranked": f"""WITH {s.FACTS}, a AS (SELECT * FROM f WHERE filed <= '1998-01-31' QUALIFY row_number() OVER (PARTITION BY cik, concept, period_end ORDER BY accession DESC, ingested_seq DESC) = 1),
 r AS (SELECT * FROM a WHERE concept IN ('F', 'O') QUALIFY row_number() OVER (PARTITION BY cik, period_end ORDER BY concept) = 1)
 SELECT cik, period_end, value, accession, rank() OVER (ORDER BY value DESC NULLS LAST) AS rank FROM r WHERE period_end >= '1995-02-01' AND period_end < '1996-02-01'""",
    "strm4_agreements": f"{CHECKS} SELECT field, min(day) AS promoted FROM c WHERE n >= 3 GROUP BY field",
    "strm5_shadow": f"{CHECKS} SELECT field, seq, n, CASE WHEN n >= 3 THEN 'promoted' WHEN run > 0 THEN 'demoted' ELSE 'pending' END AS status, n >= 3 AND date_diff('day', start, day) <= 7 AS shadow FROM c",
}
