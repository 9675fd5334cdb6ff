"""Readers that turn feeds and forms into rows."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

ENTRY = "struct<start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string>"
FEED = "struct<accessionNumber:array<string>,filingDate:array<string>,form:array<string>,items:array<string>,primaryDocument:array<string>>"
VALUE = "struct<value:string>"
POST = f"postTransactionAmounts:struct<sharesOwnedFollowingTransaction:{VALUE}>"
MOVED = f"securityTitle:{VALUE},transactionDate:{VALUE},transactionCoding:struct<transactionCode:string>,transactionAmounts:struct<transactionShares:{VALUE},transactionPricePerShare:{VALUE},transactionAcquiredDisposedCode:{VALUE}>,{POST}"
OWNERSHIP = (
    "issuer struct<issuerCik:string,issuerName:string,issuerTradingSymbol:string>, reportingOwner array<struct<reportingOwnerId:struct<rptOwnerCik:string,rptOwnerName:string>,reportingOwnerRelationship:struct<isDirector:string,isOfficer:string,officerTitle:string>>>, "
    f"periodOfReport string, nonDerivativeTable struct<nonDerivativeTransaction:array<struct<{MOVED}>>,nonDerivativeHolding:array<struct<securityTitle:{VALUE},{POST}>>>, "
    f"derivativeTable struct<derivativeTransaction:array<struct<{MOVED}>>,derivativeHolding:array<struct<securityTitle:{VALUE},{POST}>>>"
)
HOLDINGS = "infoTable array<struct<nameOfIssuer:string,titleOfClass:string,cusip:string,value:string,shrsOrPrnAmt:struct<sshPrnamt:string,sshPrnamtType:string>,putCall:string>>"
OFFERING = "primaryIssuer struct<cik:string,entityName:string>, offeringData struct<offeringSalesAmounts:struct<totalOfferingAmount:string,totalAmountSold:string,totalRemaining:string>>"


PERSON_D = "reportingPersonCIK:string,reportingPersonName:string,citizenshipOrOrganization:string,soleVotingPower:string,sharedVotingPower:string,aggregateAmountOwned:string,percentOfClass:string,typeOfReportingPerson:array<string>"
PERSON_G = "reportingPersonName:string,citizenshipOrOrganization:string,reportingPersonBeneficiallyOwnedNumberOfShares:struct<soleVotingPower:string,sharedVotingPower:string>,reportingPersonBeneficiallyOwnedAggregateNumberOfShares:string,classPercent:string,typeOfReportingPerson:array<string>"
OWNERS = f"formData struct<coverPageHeader:struct<dateOfEvent:string,eventDateRequiresFilingThisStatement:string,issuerInfo:struct<issuerCik:string,issuerName:string>>,reportingPersons:struct<reportingPersonInfo:array<struct<{PERSON_D}>>>,coverPageHeaderReportingPersonDetails:array<struct<{PERSON_G}>>>"
SALES = "formData struct<issuerInfo:struct<issuerCik:string,issuerName:string,nameOfPersonForWhoseAccountTheSecuritiesAreToBeSold:string>,securitiesInformation:array<struct<securitiesClassTitle:string,noOfUnitsSold:string,aggregateMarketValue:string,approxSaleDate:string>>,securitiesToBeSold:array<struct<securitiesClassTitle:string,acquiredDate:string,natureOfAcquisitionTransaction:string,amountOfSecuritiesAcquired:string>>>"


def plain_tags(xml: Column) -> Column:
    """XML without prefixes on elements and attributes, which from_xml takes as part of a name."""

    def plain(x: Column) -> Column:
        # Possessive, as no name holds the sign that ends it: a name without a prefix isn't read backwards again.
        without = F.regexp_replace(F.regexp_replace(x, r"(</?)[A-Za-z][\w.-]*+:", "$1"), r"(\s)(?!xmlns)[A-Za-z][\w.-]*+:([A-Za-z][\w.-]*+=)", "$1$2")
        return F.when(x.contains(":"), without).otherwise(x)

    # As an array of one, so that a form that is written by an expression is written once.
    return F.get(F.transform(F.array(xml), plain), 0)


def facts_of_concept(json: Column) -> Column:
    """Rows (unit, entry) of {units: {unit: [entries]}}, instants left out."""
    units = F.from_json(json, f"struct<units:map<string,array<{ENTRY}>>>")["units"]
    rows = F.flatten(F.transform(F.map_entries(units), lambda u: F.transform(u["value"], lambda e: F.struct(u["key"].alias("unit"), e.alias("entry")))))
    return F.filter(rows, lambda r: r["entry"]["start"].isNotNull())


def company_facts(rows: DataFrame, json: str = "json") -> DataFrame:
    """(cik, taxonomy, concept, unit, entry fields) of company facts; instants start where they end."""
    held = rows.select(F.from_json(json, f"struct<cik:long,facts:map<string,map<string,struct<units:map<string,array<{ENTRY}>>>>>>").alias("j")).select("j.cik", F.explode("j.facts").alias("taxonomy", "concepts"))
    held = held.select("cik", "taxonomy", F.explode("concepts").alias("concept", "c")).select("cik", "taxonomy", "concept", F.explode("c.units").alias("unit", "entries"))
    out = held.select("cik", "taxonomy", "concept", "unit", F.explode("entries").alias("e"))
    return out.select("cik", "taxonomy", "concept", "unit", F.coalesce("e.start", "e.end").alias("period_start"), F.col("e.end").alias("period_end"), F.col("e.val").alias("value"), F.col("e.accn").alias("accession"), F.col("e.fy").alias("fiscal_year"), F.col("e.fp").alias("fiscal_period"), F.col("e.form").alias("form"), F.col("e.filed").alias("filed"))


def frames(rows: DataFrame, json: str = "json") -> DataFrame:
    """(concept, unit, cik, period, value) of one concept for a period over all filers; filed is not known."""
    held = rows.select(F.from_json(json, "struct<taxonomy:string,tag:string,uom:string,data:array<struct<accn:string,cik:long,entityName:string,start:string,end:string,val:double>>>").alias("j"))
    return held.select(F.concat_ws(":", "j.taxonomy", "j.tag").alias("concept"), F.col("j.uom").alias("unit"), F.explode("j.data").alias("d")).select("concept", "unit", F.lpad(F.col("d.cik").cast("string"), 10, "0").alias("cik"), F.coalesce("d.start", "d.end").alias("period_start"), F.col("d.end").alias("period_end"), F.col("d.val").alias("value"), F.col("d.accn").alias("accession"), F.lit(None).cast("string").alias("filed"))


def feed(rows: DataFrame, *, forms: Sequence[str] = (), since: str | None = None, until: str | None = None, json: str = "json") -> DataFrame:
    """(cik, filing fields) of a feed of parallel arrays."""
    r = rows.select("cik", F.from_json(json, f"struct<filings:struct<recent:{FEED}>>")["filings"]["recent"].alias("r"))
    out = r.select("cik", F.explode(F.arrays_zip(*[F.coalesce(F.col(f"r.{c}"), F.array().cast("array<string>")).alias(c) for c in ("accessionNumber", "filingDate", "form", "items", "primaryDocument")])).alias("f")).select("cik", "f.*")
    for on, cond in ((forms, F.col("form").isin(*forms) if forms else None), (since, F.col("filingDate") >= since if since else None), (until, F.col("filingDate") <= until if until else None)):
        out = out.where(cond) if on else out
    return out


def first_mentions(targets: DataFrame, key: str = "cik", order: str = "pos") -> DataFrame:
    """Each key once, where it comes first."""
    return targets.groupBy(key).agg(F.min(order).alias(order))


def ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file of JSON lines up to the first that is broken or unfinished."""
    lines = spark.read.option("lineSep", "\n").text(path, wholetext=False).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    parsed = lines.withColumn("row", F.from_json("value", T._parse_datatype_string(schema).add("_bad", "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    broken = parsed.where(F.col("row").isNull() | F.col("row._bad").isNotNull()).groupBy("file").agg(F.min("at").alias("stop"))
    kept = parsed.join(broken, "file", "left").where(F.col("stop").isNull() | (F.col("at") < F.col("stop")))
    return kept.select("row.*").drop("_bad")


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def union_columns(rows: DataFrame, json: str = "data_json", order: str = "row_index") -> list[str]:
    """Names of all keys of JSON rows in the order in which they come first; the driver gets the names only."""
    keys = rows.select(order, F.posexplode(F.json_object_keys(json)).alias("k", "name"))
    return [r["name"] for r in keys.groupBy("name").agg(F.min(F.struct(order, "k")).alias("first")).orderBy("first").collect()]


def schemaless(rows: DataFrame, keep: Sequence[str], json: str = "data_json", order: str = "row_index") -> DataFrame:
    """JSON rows as a column for each key that any row has."""
    names = union_columns(rows, json, order)
    held = rows.withColumn("__m", F.from_json(json, "map<string,string>"))
    return held.select(*keep, *[F.try_element_at("__m", F.lit(n)).alias(n) for n in names])


def ownership(rows: DataFrame, xml: str = "xml") -> DataFrame:
    """A row per transaction or holding of both tables of an ownership form, the issuer and first owner with each."""
    held = rows.withColumn("x", F.from_xml(plain_tags(F.col(xml)), OWNERSHIP, {"rowTag": "ownershipDocument"}))
    owner = F.get(F.col("x.reportingOwner"), 0)
    head = [F.col("x.issuer.issuerCik").alias("issuer_cik"), F.col("x.issuer.issuerName").alias("issuer"), F.col("x.issuer.issuerTradingSymbol").alias("ticker"), owner["reportingOwnerId"]["rptOwnerName"].alias("owner"), owner["reportingOwnerRelationship"]["officerTitle"].alias("title")]
    own = [c for c in rows.columns if c != xml]
    text = lambda c, name: c.cast("string").alias(name)
    number = lambda c, name: c.try_cast("double").alias(name)
    none = F.lit(None).cast("string")

    def line(table: str, kind: str) -> Column:
        def fields(t: Column, pos: Column) -> Column:
            moved = kind == "transaction"
            return F.struct(
                F.lit(table).alias("table"), F.lit(kind).alias("kind"), pos.alias("pos"), text(t["securityTitle"]["value"], "security"), text(t["transactionDate"]["value"] if moved else none, "date"), text(t["transactionCoding"]["transactionCode"] if moved else none, "code"),
                number(t["transactionAmounts"]["transactionShares"]["value"] if moved else none, "shares"), number(t["transactionAmounts"]["transactionPricePerShare"]["value"] if moved else none, "price"), number(t["postTransactionAmounts"]["sharesOwnedFollowingTransaction"]["value"], "owned_after"),
            )

        tag = "nonDerivative" if table == "non_derivative" else "derivative"
        return F.coalesce(F.transform(f"x.{tag}Table.{tag}{kind.title()}", fields), F.array())

    lines = F.concat(*[line(table, kind) for table in ("non_derivative", "derivative") for kind in ("transaction", "holding")])
    return held.select(*own, *head, F.explode(lines).alias("l")).select(*own, "issuer_cik", "issuer", "ticker", "owner", "title", "l.*")


def holdings(rows: DataFrame, xml: str = "xml") -> DataFrame:
    """A row per holding of an information table."""
    own = [c for c in rows.columns if c != xml]
    held = rows.select(*own, F.explode(F.from_xml(plain_tags(F.col(xml)), HOLDINGS, {"rowTag": "informationTable"})["infoTable"]).alias("i"))
    return held.select(*own, F.col("i.nameOfIssuer").alias("issuer"), F.col("i.titleOfClass").alias("class"), F.col("i.cusip").alias("cusip"), F.col("i.value").try_cast("double").alias("value"), F.col("i.shrsOrPrnAmt.sshPrnamt").try_cast("double").alias("shares"), F.col("i.putCall").alias("put_call"))


def offerings(rows: DataFrame, xml: str = "xml") -> DataFrame:
    """A row per offering; an indefinite amount is null."""
    own = [c for c in rows.columns if c != xml]
    x = F.from_xml(plain_tags(F.col(xml)), OFFERING, {"rowTag": "edgarSubmission"})
    amounts = x["offeringData"]["offeringSalesAmounts"]
    return rows.select(*own, x["primaryIssuer"]["entityName"].alias("issuer"), *[amounts[k].try_cast("double").alias(n) for k, n in (("totalOfferingAmount", "offered"), ("totalAmountSold", "sold"), ("totalRemaining", "remaining"))])


def owners(rows: DataFrame, xml: str = "xml") -> DataFrame:
    """A row per reporting person of a beneficial ownership form, of either of its two layouts."""
    own = [c for c in rows.columns if c != xml]
    # The two layouts write one name in two ways.
    x = F.from_xml(F.regexp_replace(plain_tags(F.col(xml)), "issuerCIK", "issuerCik"), OWNERS, {"rowTag": "edgarSubmission"})["formData"]
    held = rows.select(*own, x.alias("x"))
    number = lambda c: F.regexp_replace(c, ",", "").try_cast("double")
    first = F.transform("x.reportingPersons.reportingPersonInfo", lambda p: F.struct(p["reportingPersonName"].alias("person"), number(p["soleVotingPower"]).alias("sole_voting"), number(p["aggregateAmountOwned"]).alias("owned"), number(p["percentOfClass"]).alias("percent"), F.concat_ws(",", p["typeOfReportingPerson"]).alias("kind")))
    second = F.transform("x.coverPageHeaderReportingPersonDetails", lambda p: F.struct(p["reportingPersonName"].alias("person"), number(p["reportingPersonBeneficiallyOwnedNumberOfShares"]["soleVotingPower"]).alias("sole_voting"), number(p["reportingPersonBeneficiallyOwnedAggregateNumberOfShares"]).alias("owned"), number(p["classPercent"]).alias("percent"), F.concat_ws(",", p["typeOfReportingPerson"]).alias("kind")))
    issuer = F.col("x.coverPageHeader.issuerInfo")
    return held.select(*own, issuer["issuerCik"].alias("issuer_cik"), issuer["issuerName"].alias("issuer"), F.posexplode(F.coalesce(first, second)).alias("pos", "p")).select(*own, "issuer_cik", "issuer", "pos", "p.*")


def planned_sales(rows: DataFrame, xml: str = "xml") -> DataFrame:
    """A row per security of a notice of sale, with the acquisition of its class, else the first one."""
    own = [c for c in rows.columns if c != xml]
    x = F.from_xml(plain_tags(F.col(xml)), SALES, {"rowTag": "edgarSubmission"})["formData"]
    held = rows.select(*own, x.alias("x")).select(*own, F.col("x.issuerInfo.issuerCik").alias("issuer_cik"), F.col("x.issuerInfo.nameOfPersonForWhoseAccountTheSecuritiesAreToBeSold").alias("person"), F.col("x.securitiesToBeSold").alias("bought"), F.posexplode("x.securitiesInformation").alias("pos", "s"))
    match = F.coalesce(F.get(F.filter("bought", lambda b: b["securitiesClassTitle"] == F.col("s.securitiesClassTitle")), 0), F.get(F.col("bought"), 0))
    return held.select(*own, "issuer_cik", "person", "pos", F.col("s.securitiesClassTitle").alias("class"), F.col("s.noOfUnitsSold").try_cast("double").alias("units"), F.col("s.aggregateMarketValue").try_cast("double").alias("value"), F.col("s.approxSaleDate").alias("sale_date"), match["acquiredDate"].alias("acquired"), match["natureOfAcquisitionTransaction"].alias("nature"))


INLINE = re.compile(r"<(/?)ix:(nonFraction|nonNumeric)\b([^>]*?)(/?)>|<[^>]*>|([^<]+)", re.I)
ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*[\"']([^\"']*)[\"']")


def inline_facts_of(source: str | None) -> list[dict]:
    """Tagged facts of a page in the order in which they end; an outer fact has the text of the inner ones too."""
    out, open_ = [], []
    for m in INLINE.finditer(source or ""):
        if m[5]:
            for f in open_:
                f["text"] += m[5]
        elif m[2] and not m[1]:
            a = {k.lower().split(":")[-1]: v for k, v in ATTRIBUTE.findall(m[3])}
            own = {"name": a.get("name"), "context": a.get("contextref"), "scale": int(a.get("scale") or 0), "negative": a.get("sign") == "-", "text": ""}
            (out if m[4] else open_).append(own)
        elif m[2] and open_:
            out.append(open_.pop())
    return out


def inline_facts(rows: DataFrame, html: str = "html") -> DataFrame:
    """A row per inline fact: name, context, text and, of numbers, the value by scale and sign."""

    @F.pandas_udf("array<struct<name:string,context:string,scale:int,negative:boolean,text:string>>")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(inline_facts_of)

    own = [c for c in rows.columns if c != html]
    found = rows.select(*own, F.posexplode(run(html)).alias("pos", "f"))
    value = F.regexp_replace("f.text", r"[$,\s]", "").try_cast("double") * F.pow(F.lit(10.0), F.col("f.scale")) * F.when(F.col("f.negative"), -1).otherwise(1)
    return found.select(*own, "pos", "f.name", "f.context", F.trim("f.text").alias("text"), value.alias("value"))


def append_guarded(new: DataFrame, graduated: DataFrame, path: str) -> None:
    """Appends field rows; refuses if any field has graduated."""
    if new.join(graduated.select("field"), "field", "left_semi").limit(1).count():
        raise ValueError("a graduated field can't be written")
    new.write.mode("append").parquet(path)


def run_id(spec: str, version: str, count: int) -> str:
    return f"{spec}@{version}#{count + 1:04d}"


def latest_first(records: DataFrame, order: str = "as_of") -> DataFrame:
    return records.orderBy(F.desc_nulls_last(order))


def documents_with_values(rows: DataFrame, keys: Sequence[str], field: str = "field", value: str = "value_json") -> DataFrame:
    """A row per document with its values by field; of repeated fields the last by value counts."""
    one = rows.groupBy(*keys, field).agg(F.max(value).alias(value))
    return one.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(field, value)))).alias("values"))


def jsonl(rows: DataFrame) -> DataFrame:
    """One JSON text a row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def newest(rows: DataFrame, keys: Sequence[str], order: str, most: int = 4000) -> DataFrame:
    """The newest rows, regrouped by document."""
    kept = rows.orderBy(F.desc(order), *keys).limit(most)
    return kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[c for c in rows.columns if c not in keys]))).alias("rows"))


def arcs(rows: DataFrame, xml: str = "xml") -> DataFrame:
    """(role, parent, child, weight, ord) of calculation links; locators give labels their concepts."""
    schema = "calculationLink array<struct<_role:string,loc:array<struct<_label:string,_href:string>>,calculationArc:array<struct<_from:string,_to:string,_weight:double,_order:double>>>>"
    own = [c for c in rows.columns if c != xml]
    link = rows.select(*own, F.explode(F.from_xml(plain_tags(F.col(xml)), schema, {"rowTag": "linkbase"})["calculationLink"]).alias("l"))
    named = link.withColumn("names", F.map_from_entries(F.transform("l.loc", lambda x: F.struct(x["_label"], F.regexp_replace(F.regexp_replace(x["_href"], "^.*#", ""), "_", ":")))))
    out = named.select(*own, F.col("l._role").alias("role"), "names", F.explode("l.calculationArc").alias("a"))
    return out.select(*own, "role", F.element_at("names", F.col("a._from")).alias("parent"), F.element_at("names", F.col("a._to")).alias("child"), F.col("a._weight").alias("weight"), F.col("a._order").alias("ord"))


def numbered(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Row index from 0 in each key."""
    return rows.withColumn("row_index", F.row_number().over(W.Window.partitionBy(*keys).orderBy(order)) - 1)


def index_types(page: Column) -> Column:
    """File name to declared type, from the table of a filing's index page: the cell after the first one with a link, row by row.

    Rows without a link (the header, whole submissions) are left out; a viewer's address is dropped from a name; of equal names the last row counts. A null
    page has no files.
    """
    rows = F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    link = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""

    def file(row: Column) -> Column:
        cells = F.regexp_extract_all(row, F.lit(r"(?is)<td\b[^>]*>(.*?)</td>"), F.lit(1))
        at = F.array_position(F.transform(cells, lambda c: c.rlike(link)), F.lit(True)).cast("int")
        name = F.trim(F.substring_index(F.substring_index(F.regexp_extract(F.try_element_at(cells, at), link, 1), "doc=", -1), "/", -1))
        kind = F.regexp_replace(F.regexp_replace(F.coalesce(F.try_element_at(cells, at + 1), F.lit("")), r"(?s)<[^>]+>", ""), r"^\s+|\s+$", "")
        return F.when(at > 0, F.struct(name.alias("key"), kind.alias("value")))

    found = F.array_compact(F.transform(rows, lambda r: F.when(r.rlike(link) & r.rlike(r"(?i)<td\b"), file(r))))
    last = F.filter(found, lambda x, i: ~F.exists(F.slice(found, i + 2, F.size(found)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


# The codes of the forms that each reader reads, and the element that their files have.
FORMS = {
    "ownership": (("3", "3/A", "4", "4/A", "5", "5/A"), "ownershipDocument"), "holdings": (("13F-HR", "13F-HR/A"), "informationTable"), "owners": (("SCHEDULE 13D", "SCHEDULE 13D/A", "SCHEDULE 13G", "SCHEDULE 13G/A"), "edgarSubmission"),
    "offerings": (("D", "D/A"), "edgarSubmission"), "planned_sales": (("144", "144/A"), "edgarSubmission"),
}


def dispatched(files: DataFrame, form: str = "form", xml: str = "xml") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of files of mixed forms: each file goes to the reader of its form code, case and blanks aside.

    rows have the files' columns but the XML, `reader`, and `row`, a variant object of what the reader gives. rejects have the files' columns but the XML and a
    reason: no reader, or XML without the form's element. A file that its reader finds nothing in has neither.
    """
    own = [c for c in files.columns if c != xml]
    code = F.upper(F.trim(F.coalesce(F.col(form), F.lit(""))))
    readers = {"ownership": ownership, "holdings": holdings, "owners": owners, "offerings": offerings, "planned_sales": planned_sales}
    parts, reason = [], F.lit(None).cast("string")
    for name, (codes, element) in FORMS.items():
        fits = F.coalesce(F.col(xml), F.lit("")).rlike(rf"<(?:\w+:)?{element}\b")
        reason = F.when(code.isin(*codes), F.when(~fits, f"no {element} in it")).otherwise(reason)
        found = readers[name](files.where(code.isin(*codes) & fits), xml)
        parts.append(found.select(*own, F.lit(name).alias("reader"), F.to_variant_object(F.struct(*[c for c in found.columns if c not in own])).alias("row")))
    known = [c for codes, _ in FORMS.values() for c in codes]
    reason = F.when(~code.isin(*known), F.concat(F.lit("no reader for form "), code)).otherwise(reason)
    return reduce(DataFrame.unionByName, parts), files.withColumn("reason", reason).where("reason is not null").drop(xml)
