"""Queries on documents and pages, events by time, filings and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import html, models, text as t
from tidemark.plans import stand_ins as s
from tidemark.plans.scalars import normal_cdf
from tidemark.sources import filings
from tidemark.streaming import events as ev
from tidemark.streaming import ranges

HEADINGS = {"table": r"\|", "shout": "^[^a-z]*[A-Z]{3,}[^a-z]*$", "release": "^Released"}


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.paragraphs(s.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), separator="\n").join(s.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")


def doc1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.normalised(s.table(spark, sf_dir, "pages"))
    return out.select("page_id", "text", F.size("spans").alias("pieces"), F.size("pairs").alias("pairs"))


def doc2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.normalised(s.table(spark, sf_dir, "pages"))
    return out.select("page_id", F.posexplode("pairs").alias("pos", "p")).select("page_id", "pos", "p.label", "p.value")


def doc3_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred letters of each page's text, found in its source."""
    out = html.normalised(s.table(spark, sf_dir, "pages"))
    r = html.resolved(F.col("spans"), F.lit(0), F.least(F.lit(100), F.length("text")))
    return out.where(F.length("text") > 0).select("page_id", r["start"].alias("start"), r["end"].alias("end"))


def agg29_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a hundredth of a language's documents have."""
    return t.boilerplate(_lines(spark, sf_dir), "lang", 0.01)


def doc5_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return t.without_boilerplate(lines, t.boilerplate(lines, "lang", 0.01), "lang", joiner="\n").select("doc_id", F.length("text").alias("n"), "reduction")


def doc6_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.sections(_lines(spark, sf_dir), HEADINGS).groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


def doc7_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.joined(t.sections(_lines(spark, sf_dir), HEADINGS), ["table", "release"]).select("doc_id", F.length("text").alias("n"))


def doc8_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as labelled lines and read again."""
    o = s.table(spark, sf_dir, "orders")
    text = F.concat(F.lit("Order:: "), F.col("o_orderkey"), F.lit("\nnot a label\nStatus:: "), F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, "\nA: 1\nB: 2\nC: 3").otherwise(""))
    return o.select("o_orderkey", F.posexplode(t.labelled(text)).alias("pos", "p")).select("o_orderkey", "pos", "p.label", "p.value")


def doc24_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = t.candidates(s.table(spark, sf_dir, "documents"))
    return t.ranked_candidates(found, "token").select("doc_id", "kind", "value", "label", "start", "rank")


def doc25_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.forward_looking(s.table(spark, sf_dir, "documents"), "(?i)\\b(the|der|les|los)\\b").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


def doc26_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = t.matches(F.col("text"), r"([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})")
    d = s.table(spark, sf_dir, "documents").select("doc_id", m.alias("m")).where("m is not null")
    return d.select("doc_id", "m.value", F.col("m.start").cast("long").alias("start"), F.col("m.end").cast("long").alias("end"))


def doc15_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = s.table(spark, sf_dir, "part")
    return p.select("p_partkey", F.posexplode(t.located(F.col("p_name"), F.split(F.upper("p_name"), " "))).alias("pos", "x")).select("p_partkey", "pos", F.col("x.start").alias("start"), F.col("x.end").alias("end"))


def scan13_schemaless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as JSON rows with different keys, read as one table."""
    li = s.table(spark, sf_dir, "lineitem")
    row = F.when(F.col("l_linenumber") % 2 == 0, F.to_json(F.struct(F.col("l_quantity").cast("int").alias("qty"), F.col("l_returnflag").alias("flag")))).otherwise(F.to_json(F.struct(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))))
    return filings.schemaless(li.select("l_orderkey", F.col("l_linenumber").alias("row_index"), row.alias("data_json")), ["l_orderkey", "row_index"])


def scan20_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as parallel arrays, read as rows."""
    o = s.table(spark, sf_dir, "orders")
    packed = o.groupBy(F.col("o_custkey").alias("cik")).agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").cast("string").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.col("o_orderstatus").alias("f")))).alias("a"))
    part = lambda i, n: F.transform("a", lambda x: x[i]).alias(n)
    recent = F.struct(part("k", "accessionNumber"), part("d", "filingDate"), part("f", "form"))
    json = F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings")))
    return filings.feed(packed.select("cik", json.alias("json")), forms=["O", "F"], since="1995-01-01").select("cik", "accessionNumber", "filingDate", "form")


def scan26_company_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = s.table(spark, sf_dir, "orders")
    entry = F.struct(F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-01-01")).alias("start"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("end"), F.col("o_totalprice").alias("val"), F.col("o_orderkey").cast("string").alias("accn"))
    per = o.groupBy("o_custkey", "o_orderstatus").agg(F.collect_list(entry).alias("e")).groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", F.struct(F.create_map(F.lit("USD"), F.col("e")).alias("units"))))).alias("c"))
    json = F.to_json(F.struct(F.col("o_custkey").alias("cik"), F.create_map(F.lit("tx"), F.col("c")).alias("facts")))
    out = filings.company_facts(per.select(json.alias("json")))
    return out.select("cik", "concept", "unit", "period_start", "period_end", "value", "accession")


def doc16_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as ownership forms, every other line as a derivative, and read again, a row a line."""
    li, o = s.table(spark, sf_dir, "lineitem"), s.table(spark, sf_dir, "orders")
    v = lambda tag, c: F.concat(F.lit(f"<{tag}><value>"), c.cast("string"), F.lit(f"</value></{tag}>"))
    line = F.concat(v("securityTitle", F.col("l_returnflag")), F.lit("<transactionCoding><transactionCode>"), F.col("l_linestatus"), F.lit("</transactionCode></transactionCoding><transactionAmounts>"), v("transactionShares", F.col("l_quantity").cast("int")), F.lit("</transactionAmounts>"))
    forms = li.join(o, li["l_orderkey"] == o["o_orderkey"]).groupBy("o_orderkey", "o_custkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("x")))).alias("lines"))

    def part(tag: str, odd: int) -> Column:
        rows = F.transform(F.filter("lines", lambda a: a["l_linenumber"] % 2 == odd), lambda a: F.concat(F.lit(f"<{tag}Transaction>"), a["x"], F.lit(f"</{tag}Transaction>")))
        return F.concat(F.lit(f"<{tag}Table>"), F.array_join(rows, ""), F.lit(f"</{tag}Table>"))

    xml = F.concat(F.lit("<ownershipDocument><issuer><issuerCik>"), F.col("o_custkey"), F.lit("</issuerCik></issuer>"), part("nonDerivative", 1), part("derivative", 0), F.lit("</ownershipDocument>"))
    return filings.ownership(forms.select("o_orderkey", xml.alias("xml"))).select("o_orderkey", "issuer_cik", "security", "code", "shares")


def doc17_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = s.table(spark, sf_dir, "part")
    row = F.concat(F.lit("<infoTable><nameOfIssuer>"), F.col("p_name"), F.lit("</nameOfIssuer><cusip>"), F.col("p_partkey"), F.lit("</cusip><value>"), F.col("p_size"), F.lit("</value></infoTable>"))
    forms = p.groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("x"))
    return filings.holdings(forms.select("p_brand", F.concat(F.lit("<informationTable>"), F.col("x"), F.lit("</informationTable>")).alias("xml"))).select("p_brand", "issuer", "cusip", "value")


def scan36_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = s.extractions(spark, sf_dir).where("value_num is not null").select("accession", "field", F.col("value_num").cast("int").cast("string").alias("value_json"))
    out = filings.documents_with_values(e.withColumn("value_json", F.lpad("value_json", 3, "0")), ["accession"])
    return out.select("accession", F.array_join(F.transform(F.map_entries("values"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("values"))


def strm_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.windowed(s.table(spark, sf_dir, "events"), "1 hour")


def strm_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.windowed(s.table(spark, sf_dir, "events"), "1 hour", "30 minutes")


def strm_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.sessions(s.table(spark, sf_dir, "events"), "30 minutes")


def strm10_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.final_days(s.table(spark, sf_dir, "events"))


def strm3_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events by a source that counts 300 rows at most and so plans its own splits; days with as many have a row that warns."""
    spark.dataSource.register(ranges.RangeSource)
    first, last = s.table(spark, sf_dir, "events").agg(F.min(F.to_date("ts")).cast("string"), F.max(F.to_date("ts")).cast("string")).first()
    options = {"path": f"{sf_dir}/events.parquet", "time": "ts", "first": first, "last": last, "cap": "300"}
    found = spark.read.format("capped_ranges").schema("event_id long, " + ranges.NOTE).options(**options).load()
    return found.select("event_id", "note", F.when(F.col("note").isNotNull(), F.col("first_day")).alias("day"))


def strm7_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.after(s.table(spark, sf_dir, "events"), 500).select("event_id", "event_type")


def strm11_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = s.table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    return ev.snapshots(e, "user_id", "day")


def ml5_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price per unit of each brand's parts by size and quantity."""
    li, p = s.table(spark, sf_dir, "lineitem"), s.table(spark, sf_dir, "part")
    rows = li.join(p, li["l_partkey"] == p["p_partkey"]).select("p_brand", F.col("p_size").cast("double").alias("a"), "l_quantity", "l_extendedprice")
    out = models.fit_groups(rows, "p_brand", ["a", "l_quantity"], "l_extendedprice")
    return out.select("p_brand", "n", "degree", F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


def agg45_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = s.table(spark, sf_dir, "lineitem")
    out = models.paired_test(li, "l_discount", "l_tax", ["l_returnflag"])
    return out.select("l_returnflag", "n", F.round("diff", 9).alias("diff"), F.round("p", 5).alias("p"))


def agg46_placebo(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = s.table(spark, sf_dir, "customer")
    return models.placebo_p(c, "c_acctbal", F.lit(9500.0)).select(F.round("p", 6).alias("p"), "verdict")


def ml9_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of orders over 27 thresholds."""
    params = spark.createDataFrame([(a, b, c) for a in (0, 1, 2) for b in (0, 1, 2) for c in (0, 1, 2)], "a int, b int, c int")
    o = s.table(spark, sf_dir, "orders").groupBy("o_orderstatus", F.month("o_orderdate").alias("m")).agg(F.count(F.lit(1)).alias("n"))
    return models.grid(o, params).where("m % 3 >= a and n % 3 <= b").groupBy("a", "b", "c").agg(F.sum("n").alias("n"))


def ml12_simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = models.simulate(spark, 160, 26, 0.0, 0.1, 0.02)
    return out.agg(F.count(F.lit(1)).alias("sims"), (F.abs(F.avg("last") - 1) < 0.05).alias("centred"), (F.abs(F.avg("vol") - 0.0205) < 0.003).alias("spread"))


QUERIES = {k: f for k, f in list(globals().items()) if k.split("_")[0].rstrip("0123456789") in ("doc", "scan", "strm", "ml", "agg") and callable(f)}

_L = "p AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS paragraph, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents), l AS (SELECT * FROM p WHERE trim(paragraph) <> '')"
_H = "sha1(trim(regexp_replace(lower(paragraph), '\\s+', ' ', 'g')))"
_B = f"{_L}, n AS (SELECT lang, count(DISTINCT doc_id) AS total FROM l GROUP BY 1), b AS (SELECT lang, {_H} AS h, count(DISTINCT doc_id) AS docs FROM l GROUP BY 1, 2), c AS (SELECT lang, h, docs, total FROM b JOIN n USING (lang) WHERE total > 1 AND docs >= ceil(total * 0.01::DOUBLE))"
_S = f"{_L}, k AS (SELECT *, CASE WHEN contains(paragraph, '|') THEN 'table' WHEN regexp_matches(paragraph, '^[^a-z]*[A-Z]{{3,}}[^a-z]*$') THEN 'shout' WHEN paragraph LIKE 'Released%' THEN 'release' END AS h FROM l), x AS (SELECT *, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos), 'cover') AS section FROM k)"
_E = "round(sum(CAST(round(value * 100) AS BIGINT)))"
ORACLE_SQL = {
    "agg29_boilerplate": f"WITH {_B} SELECT * FROM c",
    "doc5_reduced": f"WITH {_B}, m AS (SELECT l.*, c.h IS NOT NULL AS gone FROM l LEFT JOIN c ON l.lang = c.lang AND {_H} = c.h) SELECT doc_id, coalesce(sum(CASE WHEN NOT gone THEN length(paragraph) + 1 END) - 1, 0) AS n, round(100 * sum(CASE WHEN gone THEN length(paragraph) ELSE 0 END) / sum(length(paragraph)), 2) AS reduction FROM m GROUP BY 1",
    "doc6_sections": f"WITH {_S} SELECT section, count(*) AS n, count(DISTINCT doc_id) AS docs FROM x GROUP BY 1",
    "doc7_joined": f"WITH {_S} SELECT doc_id, sum(length(paragraph) + 1) - 1 AS n FROM x WHERE section IN ('table', 'release') GROUP BY 1",
    "doc8_labels": "SELECT o_orderkey, pos, label, value FROM (SELECT o_orderkey, 0 AS pos, 'Order' AS label, o_orderkey || chr(10) || 'not a label' AS value FROM orders UNION ALL SELECT o_orderkey, 1, 'Status', o_orderstatus FROM orders UNION ALL SELECT o_orderkey, 2 + i, chr(65 + i::INT), CAST(i + 1 AS VARCHAR) FROM orders, range(3) r(i) WHERE o_orderkey % 2 = 0)",
    "doc26_matches": "WITH m AS (SELECT doc_id, regexp_extract(text, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}') AS value, text FROM documents) SELECT doc_id, value, instr(text, value) - 1 AS start, instr(text, value) - 1 + length(value) AS \"end\" FROM m WHERE value <> ''",
    "doc15_located": "WITH w AS (SELECT p_partkey, p_name, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS pos FROM part) SELECT p_partkey, pos, instr(lower(p_name), lower(w)) - 1 AS start, instr(lower(p_name), lower(w)) - 1 + length(w) AS \"end\" FROM w",
    "scan13_schemaless": "SELECT l_orderkey, l_linenumber AS row_index, CASE WHEN l_linenumber % 2 = 0 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS qty, l_returnflag AS flag, CASE WHEN l_linenumber % 2 = 1 THEN l_linestatus END AS status FROM lineitem",
    "scan20_feed": "SELECT o_custkey AS cik, CAST(o_orderkey AS VARCHAR) AS accessionNumber, strftime(o_orderdate, '%Y-%m-%d') AS filingDate, o_orderstatus AS form FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderdate >= '1995-01-01'",
    "scan26_company_facts": "SELECT o_custkey AS cik, o_orderstatus AS concept, 'USD' AS unit, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-01-01') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS period_start, strftime(o_orderdate, '%Y-%m-%d') AS period_end, o_totalprice AS value, CAST(o_orderkey AS VARCHAR) AS accession FROM orders",
    "doc16_ownership": "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS issuer_cik, l_returnflag AS security, l_linestatus AS code, CAST(CAST(l_quantity AS INT) AS DOUBLE) AS shares FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "doc17_holdings": "SELECT p_brand, p_name AS issuer, CAST(p_partkey AS VARCHAR) AS cusip, CAST(p_size AS DOUBLE) AS value FROM part",
    "scan36_values": f"WITH {s.EXTRACTIONS}, v AS (SELECT accession, field, max(lpad(CAST(CAST(value_num AS INT) AS VARCHAR), 3, '0')) AS v FROM e WHERE value_num IS NOT NULL GROUP BY 1, 2) SELECT accession, string_agg(field || '=' || v, ',' ORDER BY field) AS \"values\" FROM v GROUP BY 1",
    "strm_tumbling": f"SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, CAST({_E} AS BIGINT) AS cents FROM events GROUP BY 1, 2",
    "strm_sliding": f"SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL (k * 30) MINUTE AS start, event_type, count(*) AS n, CAST({_E} AS BIGINT) AS cents FROM events, (VALUES (0), (1)) v(k) GROUP BY 1, 2",
    "strm_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM r GROUP BY user_id, k",
    "strm10_days": f"SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, CAST({_E} AS BIGINT) AS cents FROM events GROUP BY 1, 2",
    "strm3_ranges": """SELECT event_id, NULL::VARCHAR AS note, NULL::VARCHAR AS day FROM events
        UNION ALL SELECT NULL, 'full: rows may be missing', strftime(CAST(ts AS DATE), '%Y-%m-%d') FROM events GROUP BY CAST(ts AS DATE) HAVING count(*) >= 300""",
    "strm7_after": "SELECT event_id, event_type FROM events WHERE event_id > 500",
    "strm11_snapshots": "SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day) AS seen FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events)",
    "agg45_paired": f"WITH g AS (SELECT l_returnflag, count(*) AS n, avg(l_discount - l_tax) AS d, stddev_samp(l_discount - l_tax) / sqrt(count(*)) AS se FROM lineitem GROUP BY 1) SELECT l_returnflag, n, round(d, 9) AS diff, round(2 * (1 - {normal_cdf('abs(d / se)')}), 5) AS p FROM g",
    "agg46_placebo": "SELECT round((count(*) FILTER (WHERE c_acctbal >= 9500) + 1) / (count(*) + 1), 6) AS p, CASE WHEN (count(*) FILTER (WHERE c_acctbal >= 9500) + 1) / (count(*) + 1) <= 0.05 THEN 'supported' WHEN (count(*) FILTER (WHERE c_acctbal >= 9500) + 1) / (count(*) + 1) >= 0.2 THEN 'refuted' ELSE 'inconclusive' END AS verdict FROM customer",
    "ml9_grid": "WITH o AS (SELECT o_orderstatus, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2), g AS (SELECT * FROM range(3) x(a), range(3) y(b), range(3) z(c)) SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, CAST(c AS INT) AS c, sum(n) AS n FROM g JOIN o ON m % 3 >= a AND n % 3 <= b GROUP BY 1, 2, 3",
    "ml12_simulated": "SELECT 160 AS sims, true AS centred, true AS spread",
}
