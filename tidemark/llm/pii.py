"""Format-preserving pseudonyms: validated numbers and dates, keyed-permuted within their format by a Feistel network.

What is found and how it is checked: payment card numbers (13 to 19 digits, spaces or hyphens between, Luhn), social security numbers
(000-00-0000 within the numbers that are given out), telephone numbers (an international code after + or 00, an area code from 0 in parentheses, or
ten digits with hyphens or points between; digits with spaces alone aren't known from other numbers), IPv4
addresses (octets to 255), IBANs (check digits), dates (2020-01-31, 31.01.2020 and
01/31/2020 that the calendar has; days and months come out with two digits) and, as numbers
beside letters, the local parts of mail addresses. What fails its check stays as it is.

A value is a row of places, each with a radix (a digit 10, a letter the size of its ALPHABETS, an octet 256; a day of the calendar's 400-year cycle
of 146,097 days as 189 x 773). The row is halved; in each of ROUNDS rounds one half is added, place by
place and modulo the radix, to a stream from SHA-256 of key, format, round and the other half. Each round can be undone with
the key, so the network permutes the values of a format: equal values stay equal in all documents, different ones stay different, and
lengths, signs, letter cases and validity stay. A card's last digit and an IBAN's check digits are made anew from the rest. Signs between the
digits of a number don't count, so a telephone number is linked however it is written. A single place is moved by a keyed
step, never by none. Letters of scripts outside ALPHABETS stay.

Only DataFrame functions are used; matches are rare, so texts without any pass at the cost of one regular expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.rows import prepare

ROUNDS = 8
#: Runs of letters (first code point, how many) within which letters are exchanged: Latin, Latin-1, Greek, Cyrillic, Hebrew, Arabic,
#: Devanagari, Thai, Hiragana, Katakana, Chinese characters, Hangul.
ALPHABETS = (
    (0x61, 26), (0x41, 26), (0xE0, 23), (0xF8, 8), (0xC0, 23), (0xD8, 7), (0x3B1, 25), (0x391, 17), (0x430, 32), (0x410, 32), (0x5D0, 27), (0x621, 26), (0x641, 10),
    (0x905, 53), (0xE01, 46), (0x3041, 86), (0x30A1, 90), (0x4E00, 20992), (0xAC00, 11172),
)
MARK, ESCAPE = "\u0001\u0002", "\u0001\u0003"
DAYS, DATE_RADICES = 146_097, (189, 773)

# The length of each country's IBANs (the registry's), and the country codes of telephone numbers (E.164; all others have three digits).
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 "
    "LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)
COUNTRY = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def _iban_pattern() -> str:
    """IBANs by their countries' lengths, so that a word after one isn't taken for part of it; of other countries by groups of four."""
    by_length: dict[int, list[str]] = {}
    for x in IBAN_LENGTHS.split():
        by_length.setdefault(int(x[2:]) - 4, []).append(x[:2])
    known = [f"(?:{'|'.join(c)})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in sorted(by_length.items())]
    return rf"(?<![0-9A-Za-z])(?:{'|'.join(known)}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,4}})?)(?![0-9A-Za-z])"


#: The formats, in the order in which they are tried at a place.
PATTERNS = {
    "mail": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ymd": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9]|-[0-9])",
    "dmy": r"(?<![0-9.])[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?![0-9]|\.[0-9])",
    "mdy": r"(?<![0-9/])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9]|/[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9+])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    r"|(?<![0-9+])00[1-9][0-9]{0,2}[ .-](?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])"
    r"|(?<![0-9(])\(0[0-9]{1,4}\)[ -]?[0-9]{3,4}[ -]?[0-9]{2,5}(?![0-9])"
    r"|(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])"
    r"|(?<![0-9(])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
    "iban": _iban_pattern(),
    "card": r"(?<![0-9])(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9])",
}
ANY = "|".join(PATTERNS.values())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def permuted(values: Column, radices: Column, shape: Column, key: str) -> Column:
    """The Feistel network over an array of numbers below the radices; shape names the format."""
    def halved(held: Column) -> Column:
        n = F.size(held["v"])
        half = F.floor(n / 2).cast("int")
        cut = lambda x: (F.slice(x, F.lit(1), half), F.slice(x, half + 1, n - half))
        (a, b), (ra, rb) = cut(held["v"]), cut(held["r"])
        return let(F.struct(ra.alias("ra"), rb.alias("rb"), a.alias("a"), b.alias("b"), held["shape"].alias("shape")), network)

    def shifted(own: Column, other: Column, radix: Column, shape_: Column, round_: Column) -> Column:
        start = F.concat_ws("|", F.lit(key), shape_, round_.cast("string"), F.array_join(F.transform(other, lambda x: x.cast("string")), ","))
        stream = lambda t, i: F.conv(F.substring(F.sha2(F.concat_ws("|", t, i.cast("string")), 256), 1, 12), 16, 10).cast("long")
        return let(start, lambda t: F.zip_with(F.transform(own, lambda x, i: x + stream(t, i)), radix, lambda x, r: F.pmod(x, r)))

    def stepped(h: Column) -> Column:
        """A single place: a step of 1 to radix - 1."""
        step = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), h["shape"], F.lit("one")), 256), 1, 12), 16, 10).cast("long")
        return F.zip_with(h["b"], h["rb"], lambda x, r: F.pmod(x + 1 + F.pmod(step, F.greatest(r - 1, F.lit(1))), r))

    def network(h: Column) -> Column:
        def step(acc: Column, r: Column) -> Column:
            return F.when(r % 2 == 0, F.struct(shifted(acc["a"], acc["b"], h["ra"], h["shape"], r).alias("a"), acc["b"].alias("b"))).otherwise(F.struct(acc["a"].alias("a"), shifted(acc["b"], acc["a"], h["rb"], h["shape"], r).alias("b")))

        whole = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(h["a"].alias("a"), h["b"].alias("b")), step, lambda acc: F.concat(acc["a"], acc["b"]))
        return F.when(F.size(h["b"]) + F.size(h["a"]) == 1, stepped(h)).otherwise(whole)

    return let(F.struct(values.alias("v"), radices.alias("r"), shape.alias("shape")), halved)


def _letters(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))


#: Digits and the letters of ALPHABETS, as a class of a regular expression.
PLACES = "0-9" + "".join(f"{chr(a)}-{chr(a + n - 1)}" for a, n in ALPHABETS)


def _core(text: Column) -> Column:
    return F.regexp_replace(text, f"[^{PLACES}]", "")


def _first(c: Column) -> Column:
    """Code point of the first sign of a place's alphabet."""
    out = F.when(c.between("0", "9"), 48)
    for a, n in ALPHABETS:
        out = out.when(c.between(chr(a), chr(a + n - 1)), a)
    return out.otherwise(48)


def _radix(c: Column) -> Column:
    out = F.when(c.between("0", "9"), 10)
    for a, n in ALPHABETS:
        out = out.when(c.between(chr(a), chr(a + n - 1)), n)
    return out.otherwise(10)


def _sign(point: Column) -> Column:
    return F.when(point < 128, F.char(point)).otherwise(F.decode(F.unhex(F.lpad(F.hex(point), 4, "0")), "UTF-16BE"))


def _permuted_text(core: Column, kind: str, key: str) -> Column:
    """Digits and letters of a text that has nothing else; the format is the kind and the row of alphabets."""

    def of(chars: Column) -> Column:
        values = F.transform(chars, lambda c: (F.ascii(c) - _first(c)).cast("long"))
        radices = F.transform(chars, lambda c: _radix(c).cast("long"))
        shape = F.concat(F.lit(kind + ":"), F.array_join(F.transform(chars, lambda c: _first(c).cast("string")), ","))
        return F.array_join(F.zip_with(permuted(values, radices, shape, key), chars, lambda v, c: _sign(v + _first(c))), "")

    return let(_letters(core), of)


def _refilled(text: Column, core: Column) -> Column:
    """text with its digits and letters replaced by those of core, in order."""

    def of(h: Column) -> Column:
        place = lambda i: F.length(_core(F.substring(h["text"], F.lit(1), i)))
        own = lambda i: F.substring(h["text"], i, F.lit(1))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(h["text"])), lambda i: F.when(own(i).rlike(f"[{PLACES}]"), F.substring(h["core"], place(i), F.lit(1))).otherwise(own(i))), "")

    return let(F.struct(text.alias("text"), core.alias("core")), of)


def _signs(text: Column, key: str, kind: str) -> Column:
    return F.when(_core(text) == "", text).otherwise(_refilled(text, _permuted_text(_core(text), kind, key)))


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Of a digit string from its end; doubled: 1 if the last digit counts once, 0 if twice."""
    numbers = F.transform(_letters(F.reverse(digits)), lambda c, i: F.when(i % 2 == doubled, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5)).otherwise(c.cast("int")).cast("int"))
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def luhn_valid(digits: Column) -> Column:
    return _luhn_sum(digits, 1) % 10 == 0


def _card(x: Column, key: str) -> Column:
    payload = F.regexp_replace(_core(x), ".$", "")
    new = _permuted_text(payload, "card", key)
    return _refilled(x, let(new, lambda n: F.concat(n, ((10 - _luhn_sum(n, 0) % 10) % 10).cast("string"))))


def _mod97(core: Column) -> Column:
    """The remainder of an IBAN's digits, letters as 10 to 35, the first four signs moved to the end."""
    moved = F.concat(F.substring(core, F.lit(5), F.length(core)), F.substring(core, 1, 4))
    step = lambda acc, c: F.when(c.between("0", "9"), acc * 10 + F.ascii(c) - 48).otherwise(acc * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(_letters(moved), F.lit(0), lambda acc, c: step(acc, c).cast("int"))


def _iban(x: Column, key: str) -> Column:
    core = _core(x)
    body = _permuted_text(F.substring(core, F.lit(5), F.length(core)), "iban", key)
    checked = lambda b: F.concat(F.substring(core, 1, 2), F.lpad((98 - _mod97(F.concat(F.substring(core, 1, 2), F.lit("00"), b))).cast("string"), 2, "0"), b)
    return _refilled(x, let(body, checked))


def _ip(x: Column, key: str) -> Column:
    octets = F.transform(F.split(x, r"\."), lambda c: c.cast("long"))
    return F.array_join(F.transform(permuted(octets, F.array([F.lit(256).cast("long")] * 4), F.lit("ip"), key), lambda v: v.cast("string")), ".")


def _ssn(x: Column, key: str) -> Column:
    part = lambda k: F.get(F.split(x, "-"), k).cast("long")
    area = part(0) - F.when(part(0) > 666, 2).otherwise(1)
    made = permuted(F.array(area, part(1) - 1, part(2) - 1), F.array([F.lit(r).cast("long") for r in (898, 99, 9999)]), F.lit("ssn"), key)
    return let(made, lambda n: F.concat_ws("-", F.lpad((n[0] + F.when(n[0] >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((n[1] + 1).cast("string"), 2, "0"), F.lpad((n[2] + 1).cast("string"), 4, "0")))


def _new_date(date: Column, key: str) -> Column:
    zero = F.lit("1600-01-01").cast("date")
    days = F.datediff(date, zero).cast("long")
    cycle = F.floor(days / DAYS)
    rest = days - cycle * DAYS
    new = permuted(F.array(F.floor(rest / DATE_RADICES[1]), rest % DATE_RADICES[1]), F.array([F.lit(r).cast("long") for r in DATE_RADICES]), F.lit("date"), key)
    return let(new, lambda n: F.date_add(zero, (cycle * DAYS + n[0] * DATE_RADICES[1] + n[1]).cast("int")))


def _day(x: Column, kind: str) -> Column:
    """The date that a text of the kind names, null if the calendar has none."""
    sign, order = {"ymd": ("-", (0, 1, 2)), "dmy": (r"\.", (2, 1, 0)), "mdy": ("/", (2, 0, 1))}[kind]
    y, m, d = (F.get(F.split(x, sign), k) for k in order)
    return F.when(y > "0000", F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"))


def _dated(x: Column, kind: str, key: str) -> Column:
    sign, order = {"ymd": ("-", (0, 1, 2)), "dmy": (".", (2, 1, 0)), "mdy": ("/", (2, 0, 1))}[kind]

    def written(day: Column) -> Column:
        year, month, date = F.lpad(F.year(day).cast("string"), 4, "0"), F.month(day).cast("string"), F.dayofmonth(day).cast("string")
        parts = {order[0]: year, order[1]: F.lpad(month, 2, "0"), order[2]: F.lpad(date, 2, "0")}
        return F.concat_ws(sign, *[parts[k] for k in range(3)])

    return let(_new_date(_day(x, kind), key), written)


def pseudonym(x: Column, key: str) -> Column:
    """The pseudonym of one found value; what fails the check of its format stays."""
    whole = lambda kind: x.rlike(f"^(?:{PATTERNS[kind]})$")
    mail = F.concat(_signs(F.substring_index(x, "@", 1), key, "mail"), F.lit("@"), F.substring_index(x, "@", -1))
    ip_valid = F.forall(F.split(x, r"\."), lambda c: c.cast("int") <= 255)
    ssn_valid = x.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    code = F.regexp_extract(x, rf"^((?:\+|00(?=[1-9])){COUNTRY}|)", 1)
    number = F.substring(x, F.length(code) + 1, F.length(x))
    phone = F.concat(code, _signs(number, key, "phone"))
    phone_valid = F.length(_core(x)).between(8, 15)
    out = F.when(whole("mail"), mail).when(whole("ip"), F.when(ip_valid, _ip(x, key)).otherwise(x))
    for kind in ("ymd", "dmy", "mdy"):
        out = out.when(whole(kind), F.when(_day(x, kind).isNotNull(), _dated(x, kind, key)).otherwise(x))
    out = out.when(whole("ssn"), F.when(ssn_valid, _ssn(x, key)).otherwise(x)).when(whole("phone"), F.when(phone_valid, phone).otherwise(x))
    out = out.when(whole("iban") & (_mod97(_core(x)) == 1), _iban(x, key))
    return out.when(whole("card"), F.when(luhn_valid(_core(x)), _card(x, key)).otherwise(x)).otherwise(x)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with every value of a known format in the text replaced by its pseudonym under the key; count_col, if given, counts changes.

    Null and empty texts stay as they are with count 0. Repeated rows stay repeated and get the same pseudonyms. Other columns
    are kept; a column with the name count_col is replaced. An empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    text = F.col(text_col)
    marked = F.regexp_replace(F.replace(text, F.lit("\u0001"), F.lit(ESCAPE)), f"({ANY})", f"{MARK}$1{MARK}")
    pieces = F.split(F.col("__tm_marked"), MARK)
    rest = [c for c in docs.columns if c != count_col]
    # The new values are made once, in a projection of their own.
    made = docs.select(*rest, marked.alias("__tm_marked")).withColumn("__tm_new", F.when(F.contains("__tm_marked", F.lit(MARK)), F.transform(pieces, lambda x, i: F.when(i % 2 == 1, pseudonym(x, key)).otherwise(x))))
    joined = F.replace(F.array_join("__tm_new", ""), F.lit(ESCAPE), F.lit("\u0001"))
    changed = F.coalesce(F.size(F.filter(F.zip_with(F.col("__tm_new"), pieces, lambda a, b: a != b), lambda x: x)), F.lit(0))
    out = [F.coalesce(joined, text).alias(text_col) if c == text_col else F.col(c) for c in rest]
    return made.select(*out, *([F.when(F.col("__tm_new").isNull(), 0).otherwise(changed).alias(count_col)] if count_col else []))
