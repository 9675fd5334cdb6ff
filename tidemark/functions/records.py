"""Checks of records against specs, choice of a filing's documents, slices of time, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Form types of a main document, endings of file kinds.
MAIN_FORMS = ("424B2", "424B3", "424B4", "424B5", "424B7", "424B8")
GRAPHICS, XML, HTML = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tif", ".tiff"), (".xml", ".xsd"), (".htm", ".html")


def _ends(name: Column, endings: Sequence[str]) -> Column:
    out = F.lit(False)
    for e in endings:
        out = out | name.endswith(e)
    return out


def document_kind(name: Column, form: Column) -> Column:
    """ex107, primary, graphic, xbrl_data, xml, exhibit or other, by a document's form type and file name; the first that fits."""
    low, up = F.lower(F.coalesce(name, F.lit(""))), F.upper(F.trim(F.coalesce(form, F.lit(""))))
    fee = up.rlike(r"EX-?107|FILING FEE") | low.rlike(r"ex-?107|filingfee")
    kinds = ((fee, "ex107"), (up.isin(*MAIN_FORMS), "primary"), ((up == "GRAPHIC") | _ends(low, GRAPHICS), "graphic"), (F.contains(up, F.lit("XBRL")) & ~_ends(low, HTML), "xbrl_data"), (_ends(low, XML), "xml"), (up.startswith("EX-") | low.rlike(r"^ex\d"), "exhibit"))
    out = F.lit("other")
    for holds, kind in reversed(kinds):
        out = F.when(holds, kind).otherwise(out)
    return out


def main_document(name: Column, size: Column) -> Column:
    """Aggregate: the largest page that is no index, else the largest page, else the largest text; null without any."""
    low, bytes_ = F.lower(F.coalesce(name, F.lit(""))), F.coalesce(size, F.lit(0))
    page = _ends(low, HTML)
    best = lambda holds: F.max_by(F.when(holds, name), F.when(holds, F.struct(bytes_, F.hash(name))))
    return F.coalesce(best(page & ~low.rlike("^(0001|index)")), best(page), best(low.endswith(".txt")))


def press_release(name: Column, number: Column) -> Column:
    """Aggregate: the name of exhibit 99.1, else of the lowest-numbered exhibit 99; null without any."""
    return F.min_by(name, F.when(number.isNotNull(), F.struct((number != 1).alias("other"), number)))


def field_errors(fields: Mapping[str, Mapping[str, object]], present: Mapping[str, Column], values: Mapping[str, Column], kinds: Mapping[str, Column]) -> Column:
    """Errors of a record against a spec, in the spec's order: a missing required field, a null, a wrong type, a value outside the enum.

    fields: name to required, nullable, type, enum. For each field, present tells whether the record has it, values its text and kinds
    its type's name. A field that has an error of type isn't held to its enum.
    """
    found = []
    for name, spec in fields.items():
        rules = [(~present[name] & F.lit(bool(spec.get("required"))), F.lit(f"missing:{name}")), (~present[name], F.lit(None)), (values[name].isNull(), F.lit(None) if spec.get("nullable") else F.lit(f"null:{name}"))]
        if spec.get("type"):
            rules.append((kinds[name] != spec["type"], F.concat(F.lit(f"type:{name}:"), kinds[name])))
        if spec.get("enum"):
            rules.append((~values[name].isin(*spec["enum"]), F.lit(f"enum:{name}")))
        out = F.lit(None).cast("string")
        for holds, error in reversed(rules):
            out = F.when(holds, error).otherwise(out)
        found.append(out)
    return F.filter(F.array(*found), lambda e: e.isNotNull())


def required_by_kind(kind: Column, needs: Mapping[str, Mapping[str, Column]]) -> Column:
    """Names of the fields that a record's kind asks for and that are null, empty or an empty array."""
    table = {k: F.array(*[F.when(~F.coalesce(has, F.lit(False)), F.lit(name)) for name, has in fields.items()]) for k, fields in needs.items()}
    out = F.array().cast("array<string>")
    for k, names in table.items():
        out = F.when(kind == k, names).otherwise(out)
    return F.filter(out, lambda n: n.isNotNull())


def given(x: Column) -> Column:
    """Whether a text is there and not empty."""
    return F.coalesce(x != "", F.lit(False))


def record_flags(known: Sequence[str], required: Sequence[str], record: Column, waived: Column | None = None, wire: Mapping[str, str] | None = None) -> Column:
    """Flags of a record (a map of texts): missing_required or waived for a required field that is null, wire_key_leak and unknown_field for other keys."""
    wire = wire or {}
    absent = [F.when(F.try_element_at(record, F.lit(f)).isNull(), F.concat(F.when(F.coalesce(waived, F.lit(False)) if waived is not None else F.lit(False), "waived").otherwise("missing_required"), F.lit(f":{f}"))) for f in required]
    other = F.transform(F.array_sort(F.filter(F.map_keys(record), lambda k: ~k.isin(*known))), lambda k: F.concat(F.when(k.isin(*wire), "wire_key_leak:").otherwise("unknown_field:"), k))
    return F.concat(F.filter(F.array(*absent), lambda x: x.isNotNull()) if absent else F.array().cast("array<string>"), other)


def cross_failed(rule: str, a: Column, b: Column, tolerance_pct: float = 0.0) -> Column:
    """Whether a pair of values breaks a rule; a missing side never does. Dates: date_after, date_after_or_equal; numbers: lt, lte, gt, gte, equals."""
    holds = {"date_after": a > b, "date_after_or_equal": a >= b, "lt": a < b, "lte": a <= b, "gt": a > b, "gte": a >= b, "equals": F.abs(a - b) <= F.abs(b) * (tolerance_pct / 100) if rule == "equals" else None}[rule]
    return F.coalesce(~holds, F.lit(False))


def slices(start: Column, end: Column, n: int) -> Column:
    """At most n date slices (start, end) that cover start to end without gaps, as equal as whole days allow, halves to the even day."""
    span = F.datediff(end, start) + 1
    parts = F.greatest(F.lit(1), F.least(F.lit(n), span))
    edge = lambda k: F.date_add(start, F.bround(k * span / parts, 0).cast("int"))
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(edge(k).alias("start"), F.date_sub(edge(k + 1), 1).alias("end")))


def months(start: Column, end: Column) -> Column:
    """The months from start to end as (start, end), cut at both."""
    return F.transform(F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month")), lambda m: F.struct(F.greatest(m, start).alias("start"), F.least(F.last_day(m), end).alias("end")))


def kept_columns(columns: Sequence[str], wanted: Sequence[str]) -> list[str]:
    """The wanted columns that are there, in the order wanted."""
    return [c for c in wanted if c in set(columns)]
