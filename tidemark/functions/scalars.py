"""Scalar functions of columns: identifiers, dates, periods, numbers, names, rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_of(*choices: Column) -> Column:
    return F.coalesce(*choices)


# Identifiers


def pad_cik(x: Column) -> Column:
    return F.lpad(x.cast("string"), 10, "0")


def bare_cik(x: Column) -> Column:
    return F.regexp_replace(x, "^0+(?=.)", "")


def display_name(x: Column) -> Column:
    """name, tickers and cik of `NAME (T1, T2) (CIK 0000000001)`."""
    tickers = F.regexp_extract(x, r"\(([A-Z0-9.\-]+(?:, ?[A-Z0-9.\-]+)*)\)\s*\(CIK", 1)
    return F.struct(F.trim(F.regexp_replace(x, r"\s*\(.*$", "")).alias("name"), F.when(tickers != "", F.split(tickers, ", ?")).otherwise(F.array().cast("array<string>")).alias("tickers"), F.regexp_extract(x, r"\(CIK (\d+)\)", 1).alias("cik"))


def hit_parts(x: Column) -> Column:
    """accession and document of `accession:document`."""
    return F.struct(F.substring_index(x, ":", 1).alias("accession"), F.when(F.contains(x, F.lit(":")), F.regexp_replace(x, "^[^:]*:", "")).alias("document"))


def _digit_sum(value: Column) -> Column:
    return F.floor(value / 10) + value % 10


def _sign_values(x: Column, alphabet: str) -> Column:
    """Places in the alphabet of the letters of a text, null for others."""
    return F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.nullif(F.instr(F.lit(alphabet), c), F.lit(0)) - 1)


ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def valid_cusip(x: Column, extra: str = "") -> Column:
    """Nine signs whose last is the double-add-double check digit; `extra` may be "*@#"."""
    s = F.upper(F.trim(F.coalesce(x, F.lit(""))))
    values = _sign_values(F.substring(s, 1, 8), ALNUM + extra)
    doubled = F.transform(values, lambda v, i: _digit_sum(v * F.when(i % 2 == 1, 2).otherwise(1)))
    total = F.aggregate(doubled, F.lit(0).cast("double"), lambda a, v: a + v)
    return F.when((F.length(s) != 9) | ~s.rlike("[0-9]$") | F.exists(values, lambda v: v.isNull()), False).otherwise((10 - total % 10) % 10 == F.substring(s, 9, 1).cast("int"))


def valid_isin(x: Column) -> Column:
    """A country, nine signs and the Luhn digit over letters as numbers."""
    s = F.upper(F.trim(F.coalesce(x, F.lit(""))))
    digits = F.reverse(F.array_join(F.transform(_sign_values(F.substring(s, 1, 11), ALNUM), lambda v: v.cast("string")), ""))
    total = F.aggregate(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c, i: _digit_sum(c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1))), F.lit(0).cast("double"), lambda a, v: a + v)
    return F.when(~s.rlike("^[A-Z]{2}[0-9A-Z]{9}[0-9]$"), False).otherwise((10 - total % 10) % 10 == F.substring(s, 12, 1).cast("int"))


def cache_key(*parts: Column) -> Column:
    """SHA-256 over parts of which any can be null; null is unlike every text."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)


def content_hash(x: Column) -> Column:
    return F.substring(F.sha1(x), 1, 10)


# Text


def collapsed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def alnum_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def words_key(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def camel_label(x: Column) -> Column:
    """Words of a camel-case label in lower case without footnote marks."""
    return collapsed(F.lower(F.regexp_replace(F.regexp_replace(x, r"\(\d+\)", ""), "([a-z0-9])([A-Z])", "$1 $2")))


def clean_name(x: Column) -> Column:
    """A name without marks and lead-ins, in lower case, without trailing signs."""
    return F.regexp_replace(collapsed(F.lower(F.regexp_replace(F.regexp_replace(x, "[®™©*†]", ""), "(?i)^(the|shares? of|common stock of)\\s+", ""))), "[ ,.;:]+$", "")


def clean_names(names: Column) -> Column:
    """Names without invisible letters and line ends; two funds or indices printed as one are told apart if each part is one."""
    plain = F.filter(F.transform(names, lambda n: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(n, F.lit("")), "[\u200b-\u200f\u202a-\u202e\u2060\ufeff]", ""), r"\s+", " "))), lambda n: n != "")
    parts = lambda n: F.split(n, r"(?<=\b(?:Index|ETF|Fund|Trust)(?:®|SM|TM)?(?:®|SM|TM)?)\s+(?=[A-Z])")
    whole = lambda ps: F.forall(ps, lambda p: p.rlike(r"(?:Index|ETF|Fund|Trust)(?:®|SM|TM)*$"))
    return F.flatten(F.transform(plain, lambda n: F.when(whole(parts(n)), parts(n)).otherwise(F.array(n))))


def paragraph_hash(x: Column) -> Column:
    return F.sha1(collapsed(F.lower(x)))


def around(text: Column, offset: Column, window: int = 500) -> Column:
    """The text up to `window` letters before and after an offset (from 0)."""
    start = F.greatest(offset - window, F.lit(0))
    return F.substring(text, start + 1, F.least(offset + window, F.length(text)) - start)


def signals(text: Column, weights: Mapping[str, float]) -> Column:
    """Sum of the weights of the patterns that a text matches."""
    out = F.lit(0.0)
    for pattern, w in weights.items():
        out = out + F.when(text.rlike(pattern), F.lit(w)).otherwise(0.0)
    return out


def best_kind(scores: Mapping[str, Column], least: float) -> Column:
    """kind with the greatest score and whether it is sure: it reaches `least` and no other has as much."""
    ranked = F.sort_array(F.array(*[F.struct(s.alias("score"), F.lit(k).alias("kind")) for k, s in scores.items()]), asc=False)
    top, next_ = F.get(ranked, 0), F.get(ranked, 1)
    return F.struct(top["kind"].alias("kind"), (F.coalesce(top["score"] >= least, F.lit(False)) & (next_.isNull() | (top["score"] > next_["score"]))).alias("sure"))


def first_match(text: Column, patterns: Mapping[str, str]) -> Column:
    """The name of the first pattern that a text matches, null if none."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(list(patterns.items())):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def filing_stage(text: Column) -> Column:
    low = F.lower(text)
    return F.when(F.contains(low, F.lit("preliminary")), "preliminary").when(F.contains(low, F.lit("final")), "final")


def vocabulary(text: Column, anchors: Sequence[str]) -> Column:
    """Null without anchors, else whether the text has any."""
    if not anchors:
        return F.lit(None).cast("boolean")
    low = F.lower(text)
    out = F.lit(False)
    for a in anchors:
        out = out | F.contains(low, F.lit(a.lower()))
    return out


# Numbers and dates in text

NUMBER = r"-?\d[\d,]*(?:\.\d+)?"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def as_number(x: Column) -> Column:
    """`$1,000` and `70.00%` as numbers, null for what isn't one."""
    return F.try_cast(F.regexp_replace(F.trim(x), r"[$,%\s]", ""), "double") if hasattr(F, "try_cast") else F.regexp_replace(F.trim(x), r"[$,%\s]", "").try_cast("double")


def as_flag(x: Column) -> Column:
    low = F.lower(F.trim(x))
    return F.when(low.isin("1", "true"), True).when(low.isin("0", "false"), False)


def scaled(x: Column, scale: Column, negative: Column) -> Column:
    return as_number(x) * F.pow(F.lit(10.0), F.coalesce(scale, F.lit(0))) * F.when(negative, -1).otherwise(1)


def numbers_in(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)), lambda n: F.regexp_replace(n, ",", "").cast("double"))


def iso_date(x: Column) -> Column:
    """The first date of a text, as January 2, 2024, then 2 January 2024, 2024-01-02 and 1/2/2024; null if none."""
    mdy = F.regexp_extract(x, rf"(?i)\b((?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}})\b", 1)
    dmy = F.regexp_extract(x, rf"(?i)\b(\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}})\b", 1)
    iso, slash = F.regexp_extract(x, r"\b(\d{4}-\d{2}-\d{2})\b", 1), F.regexp_extract(x, r"\b(\d{1,2}/\d{1,2}/\d{4})\b", 1)
    parsed = lambda t, p: F.when(t != "", F.date_format(F.try_to_date(F.initcap(F.regexp_replace(F.regexp_replace(t, ",", ""), r"\s+", " ")), p), "yyyy-MM-dd"))
    return F.coalesce(parsed(mdy, "MMMM d yyyy"), parsed(dmy, "d MMMM yyyy"), parsed(iso, "yyyy-MM-dd"), parsed(slash, "M/d/yyyy"))


def date_or_same(x: Column) -> Column:
    """Three formats as ISO; what fits none stays."""
    t = lambda p: F.date_format(F.try_to_date(x, p), "yyyy-MM-dd")
    return F.coalesce(F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), t("yyyy-MM-dd")), F.when(x.rlike(r"^\d{2}/\d{2}/\d{4}$"), t("MM/dd/yyyy")), F.when(x.rlike(r"^\d{8}$"), t("yyyyMMdd")), x)


def states_number(text: Column, value: Column) -> Column:
    """Null for a null value, else whether the text has the number, as a hundredth or hundred times it too."""
    near = lambda a, b: F.abs(a - b) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(b))
    return F.when(value.isNotNull(), F.exists(numbers_in(text), lambda n: near(n, value) | near(n, value * 100) | near(n, value / 100)))


def ungrounded(text: Column, values: Column) -> Column:
    """Numbers of a text that no value (an array of texts) has in it."""
    return F.filter(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)), lambda n: ~F.exists(values, lambda v: F.contains(v, n)))


# Periods


def period_ok(x: Column) -> Column:
    return x.rlike(r"^CY\d{4}(Q[1-4]I?)?$")


def period_label(x: Column) -> Column:
    """year and kind (FY, Q1 to Q4) of a label; a quarter beats a year's words."""
    low = F.lower(x)
    quarter = F.coalesce(F.nullif(F.regexp_extract(low, r"\bq([1-4])\b", 1), F.lit("")), F.when(low.rlike(r"\bfirst\b.*quarter"), "1").when(low.rlike(r"\bsecond\b.*quarter"), "2").when(low.rlike(r"\bthird\b.*quarter"), "3").when(low.rlike(r"\bfourth\b.*quarter"), "4"))
    kind = F.coalesce(F.concat(F.lit("Q"), quarter), F.when(low.rlike(r"full[ -]year|fiscal year|annual|\bfy\s?\d"), "FY"))
    return F.struct(F.nullif(F.regexp_extract(x, r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1), F.lit("")).cast("int").alias("year"), kind.alias("kind"))


def filing_year(accession: Column) -> Column:
    """The year in the middle of an accession number."""
    yy = F.regexp_extract(accession, r"^\d{10}-(\d{2})-\d{6,8}$", 1)
    return F.when(yy != "", yy.cast("int") + F.when(yy.cast("int") >= 90, 1900).otherwise(2000))


def quarter_label(end: Column, year_start: Column) -> Column:
    """Q1 to Q3 by days from the year's start, Q without one."""
    n = F.least(F.greatest(F.floor(F.datediff(end, year_start) / 91) + 1, F.lit(1)), F.lit(3))
    return F.when(year_start.isNull(), "Q").otherwise(F.concat(F.lit("Q"), n.cast("string")))


def calendar_quarter(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string"))


def month_of(iso: Column) -> Column:
    return F.when(F.length(iso) >= 7, F.substring(iso, 1, 7))


def concepts_for(metric: Column, table: Mapping[str, Sequence[str]], words: Mapping[str, str]) -> Column:
    """Concepts of a metric: by its name, else by a name inside it, else by a word."""
    m = F.lower(F.trim(metric))
    lists = {k: F.array(*[F.lit(c) for c in v]) for k, v in table.items()}
    out = F.when(m == "", F.array().cast("array<string>"))
    for k, v in lists.items():
        out = out.when(m == k, v)
    for k, v in lists.items():
        out = out.when(F.contains(m, F.lit(k)), v)
    for word, k in words.items():
        out = out.when(F.contains(m, F.lit(word)), lists[k])
    return out.otherwise(F.array().cast("array<string>"))


def tolerance_range(text: Column) -> Column:
    """low and high of `X plus or minus n%` (or basis or percentage points), with thousand, million and billion."""
    pattern = r"(?i)\$?([\d,.]*\d)\s*(thousand|million|billion)?\s*,?\s*(?:±|\+/-|plus or minus)\s*([\d.]*\d)\s*(%|percentage points?|pp|basis points?|bps?)"
    part = lambda k: F.regexp_extract(text, pattern, k)
    word = F.lower(part(2))
    base = F.regexp_replace(F.nullif(part(1), F.lit("")), ",", "").cast("double") * F.when(word == "thousand", 1e3).when(word == "million", 1e6).when(word == "billion", 1e9).otherwise(1.0)
    n, unit = F.nullif(part(3), F.lit("")).cast("double"), F.lower(part(4))
    by = F.when(unit == "%", base * n / 100).when(unit.startswith("b"), n / 100).otherwise(n)
    return F.struct((base - by).alias("low"), (base + by).alias("high"))


# Rules


def midpoint(low: Column, high: Column) -> Column:
    return F.when(low.isNotNull() & high.isNotNull(), (low + high) / 2).otherwise(F.coalesce(low, high))


def per_cent_of(value: Column, base: Column) -> Column:
    return F.when(base > 0, value / base * 100)


def spans_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 < b1) & (b0 < a1)


def confidence(x: Column) -> Column:
    """A value from 0 to 1, else -1."""
    return F.when(x.between(0.0, 1.0), x).otherwise(F.lit(-1.0))


def same_number(a: Column, b: Column) -> Column:
    return (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= 1e-6, F.lit(False))


def same_text(a: Column, b: Column) -> Column:
    return F.lower(F.trim(a)).eqNullSafe(F.lower(F.trim(b)))


def same_list(a: Column, b: Column) -> Column:
    key = lambda x: F.array_sort(F.transform(x, lambda v: F.lower(F.trim(v))))
    return key(a).eqNullSafe(key(b))


def flags(*rules: tuple[Column, str]) -> Column:
    """Names of the rules that hold, in order."""
    return F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in rules]), lambda x: x.isNotNull())


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The first rule that holds, null if none."""
    return F.coalesce(*[F.when(c, F.lit(name)) for c, name in rules])


def withheld(value: Column, codes: Column, span: Column) -> Column:
    """The reason to hold a value back, the gravest first: bad_format, not_in_document, out_of_bounds, no_span."""
    return F.when(value.isNull(), F.lit(None).cast("string")).when(F.array_contains(codes, "bad_format"), "bad_format").when(F.array_contains(codes, "not_in_document"), "not_in_document").when(F.array_contains(codes, "out_of_bounds"), "out_of_bounds").when(span.isNull(), "no_span")


def token_cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Cost of tokens at prices for a million."""
    return F.round((tokens_in * price_in + tokens_out * price_out) / 1e6, 6)


# Filings


def items(x: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda v: F.trim(v)), lambda v: v != "")


def event_types(codes: Column, kinds: Mapping[str, str]) -> Column:
    """Kinds of the known codes, each once."""
    table = F.create_map(*[F.lit(v) for kv in kinds.items() for v in kv])
    return F.array_distinct(F.filter(F.transform(codes, lambda c: F.try_element_at(table, c)), lambda v: v.isNotNull()))


def exhibit_number(name: Column, kind: Column) -> Column:
    """Number of an EX-99 exhibit by its type, else by its file name; 0 without one, null for others."""
    return F.when(kind.rlike(r"(?i)^EX-99"), F.coalesce(F.nullif(F.regexp_extract(kind, r"(?i)^EX-99\.(\d+)", 1), F.lit("")).cast("int"), F.lit(0))).when(
        name.rlike(r"(?i)ex[-_]?99"), F.coalesce(F.nullif(F.regexp_extract(name, r"(?i)ex[-_]?99[-_.]?(\d+)", 1), F.lit("")).cast("int"), F.lit(0))
    )


def statement_area(concept: Column, areas: Mapping[str, Sequence[str]]) -> Column:
    """Area of a concept by words in its name, the first area wins."""
    out = F.when(concept.isNull(), F.lit(None).cast("string"))
    for area, words in areas.items():
        out = out.when(concept.rlike("(?i)" + "|".join(words)), area)
    return out.otherwise("other")
