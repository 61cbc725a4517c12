"""Format-preserving Feistel pseudonyms, in DataFrame functions only.

Validated card numbers, IBANs, social security and phone numbers, IP addresses and dates, and with them e-mail local
parts and secrets, are permuted by a keyed Feistel network within their own format: digits stay digits, cards keep a
valid check digit, dates stay dates. Equal values get equal pseudonyms in every document, so links survive; the key
alone can undo them.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialscope.llm.common import fresh, text_of

#: The session setting that holds the key.
KEY = "spark.trialscope.pii.key"
TURNS = 8
#: Dates are permuted among the days from the first to the last.
FIRST, LAST = dt.date(1900, 1, 1), dt.date(2099, 12, 31)

#: Countries by the length of their IBANs.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """An IBAN as it is stored, or of a known country as it is printed: in groups of four, by blanks or hyphens."""
    rest = lambda n: rf"(?:[ -]?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf"[ -]?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    printed = "|".join(rf"(?:{lands.replace(' ', '|')})\d{{2}}{rest(n)}" for n, lands in IBAN_LENGTHS.items())
    return rf"(?<![A-Za-z0-9])(?:[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}}|{printed})(?![A-Za-z0-9])"


#: The formats looked for, the earlier ones first.
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,2}[=:]\s{0,2}[\"']?[A-Za-z0-9+/_-]{8,}[\"']?)",
    "iban": _iban_pattern(),
    "ip6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*\d)[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![0-9A-Za-z:])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}([./])\d{1,2}\1\d{4})(?![\d/-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)[2-6]\d{3}(?:[ -]?\d){9,15}(?!\d)",
    "phone": r"(?<![\dA-Za-z])(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
}
#: Cards as they are printed, and any grouping of a run's first digits. Which of them are valid no pattern can tell.
PRINTED = [r"[2-6]\d{3}(?:[ -]?\d{4}){3}", r"[2-6]\d{3}[ -]?\d{6}[ -]?\d{5}", r"[2-6]\d{3}[ -]?\d{6}[ -]?\d{4}", r"[2-6]\d{3}(?:[ -]?\d{4}){3}[ -]?\d{3}", r"[2-6]\d{12,18}"]
OTHER = [rf"(?<!\d[ -])[2-6]\d{{3}}(?:[ -]?\d){{{n}}}" for n in range(15, 8, -1)]
RUN = r"\d(?:[ -]?\d){12}"
#: In the pattern of a text this stands for its valid cards.
CARDS = "@CARDS@"


def _phone_pattern() -> str:
    """Phone numbers that end where they are complete or where another format starts."""
    card = rf"(?<![\d.-])(?:{CARDS})(?!\d)"
    octet = r"(?:[01]?\d?\d|2[0-4]\d|25[0-5])(?!\d)"
    ip = rf"(?<![\d.]){octet}(?:\.{octet}){{3}}(?!\.?\d)"
    date = r"(?<![\d./-])(?:(?:19|20)\d{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])|\d{1,2}(?:\.\d{1,2}\.|/\d{1,2}/)(?:19|20)\d{2})(?![\d/-])"
    apart = f"{card}|{ip}|{date}"
    also = rf"{apart}|(?<![\d-])(?!000|666|9)\d{{3}}-(?!00)\d{{2}}-(?!0000)\d{{4}}(?![\d-])|(?<!\d)\d{{3}}[.-]\d{{3}}[.-]\d{{4}}(?!\d)|(?<!\d)(?:0?[1-9]|1[0-2])/\d{{2}}(?:\d{{2}})?(?![\d/])"
    group = lambda n, no: rf"[ .-]?(?!{no})\d{{{n}}}"
    area = lambda n: rf"\(?\d{{{n}}}\)?"
    start = rf"\+\d{{1,3}}[ .-]?(?!{card})"
    national = r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?![.-]?\d)"
    whole = rf"{start}(?:{area(2)}{group(4, apart)}|{area(3)}{group('3,4', apart)}|{area(4)}{group('2,4', apart)}){group(4, apart)}(?![.-]?\d)"
    strict = rf"{start}(?!{also}){area('2,4')}(?:{group('2,4', also)}){{2,3}}(?!\d)"
    loose = rf"{start}{area('2,4')}(?:{group('2,4', apart)}){{2}}(?:{group('2,4', also)})?(?!\d)"
    return rf"(?<![\dA-Za-z])(?:{national}|{whole}|{strict}|{loose}|\(\d{{3}}\) ?\d{{3}}[ .-]\d{{4}}|\d{{3}}[.-]\d{{3}}[.-]\d{{4}})(?!\d)"


SOUGHT = FORMATS | {"card": rf"(?<!\d)(?:{CARDS})(?!\d)", "phone": _phone_pattern()}
ANY = "|".join(p.replace(r"\1", r"\2") if k == "date" else p for k, p in SOUGHT.items()).replace(r"([./])", r"(?<sep>[./])").replace(r"\2", r"\k<sep>")
NO_CARDS = ANY.replace(CARDS, "(?!)")
#: A text without any of these holds none of the formats.
GATE = r"[0-9@=:]|AKIA"


def key_of(spark: SparkSession) -> str:
    """The session's key: the setting KEY, or a random one drawn once a session. Without the setting, values stay linked
    within the session alone."""
    key = spark.conf.get(KEY, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY, key)
    return key


def _secret(key: str) -> Column:
    return F.lit(hashlib.sha256(key.encode()).hexdigest())


def _noise(key: Column, turn: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, turn.cast("string"), other.cast("string")).cast("binary"), 256)


def _shifted(half: Column, noise: Column) -> Column:
    """Each digit and ASCII letter moved within its class by the noise of its place; all else stays."""

    def one(i):
        c = F.substring(half, i, F.lit(1))
        by = F.conv(F.substring(noise, 2 * F.pmod(i - 1, F.lit(32)) + 1, F.lit(2)), 16, 10).cast("int")
        move = lambda base, n: F.char(F.lit(base) + F.pmod(F.ascii(c) - base + by, F.lit(n)))
        return F.when(c.rlike("[0-9]"), move(48, 10)).when(c.rlike("[a-z]"), move(97, 26)).when(c.rlike("[A-Z]"), move(65, 26)).otherwise(c)

    places = F.when(F.length(half) > 0, F.sequence(F.lit(1), F.length(half))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(places, one), "")


def permuted(value: Column, key: Column, kind: str) -> Column:
    """A Feistel network over the two halves of a string, within each character's class."""
    cut = F.length(value).cast("int").bitwiseAND(-2) / 2
    start = F.struct(F.substring(value, F.lit(1), cut.cast("int")).alias("l"), F.substring(value, cut.cast("int") + 1, F.length(value)).alias("r"))
    own = F.concat(key, F.lit(kind))

    def turn(s, i):
        even = F.pmod(i, F.lit(2)) == 0
        return F.struct(F.when(even, _shifted(s["l"], _noise(own, i, s["r"]))).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(_shifted(s["r"], _noise(own, i, s["l"]))).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(TURNS - 1)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def permuted_number(left: Column, right: Column, key: Column, kind: str, a: int | Column, b: int | Column) -> Column:
    """A Feistel network over a pair of numbers below a and b; a struct (l, r)."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    own = F.concat(key, F.lit(kind))
    word = lambda i, x: F.conv(F.substring(_noise(own, i, x), 1, 12), 16, 10).cast("long")

    def turn(s, i):
        even = F.pmod(i, F.lit(2)) == 0
        return F.struct(F.when(even, F.pmod(s["l"] + word(i, s["r"]), a)).otherwise(s["l"]).cast("long").alias("l"), F.when(even, s["r"]).otherwise(F.pmod(s["r"] + word(i, s["l"]), b)).cast("long").alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(TURNS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _card(m: Column, key: Column) -> Column:
    """The first digit stays, as it tells a card's kind, and the check digit follows from the others."""
    head = F.concat(F.substring(m, 1, 1), permuted(F.substring(m, F.lit(2), F.length(m) - 2), key, "card"))
    tail = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: F.call_function("luhn_check", F.concat(_digits(head), d.cast("string"))))
    return F.concat(head, F.element_at(tail, 1).cast("string"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _mod97(value: Column) -> Column:
    """The remainder of an IBAN, its first four characters at the end and letters as numbers from 10."""
    turned = F.concat(F.substring(value, F.lit(5), F.length(value)), F.substring(value, 1, 4))
    code = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda a, c: F.pmod(F.when(code(c) > 9, a * 100).otherwise(a * 10) + code(c), F.lit(97)).cast("long")
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0).cast("long"), step)


def _compact(m: Column) -> Column:
    return F.regexp_replace(m, "[ -]", "")


def _laid_out(value: Column, as_: Column) -> Column:
    """The characters of value in the places of as_, whose blanks and hyphens stay."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def place(s, c):
        gap = c.isin(" ", "-")
        return F.struct(F.concat(s["out"], F.when(gap, c).otherwise(F.substring(value, s["at"], F.lit(1)))).alias("out"), F.when(gap, s["at"]).otherwise(s["at"] + 1).alias("at"))

    return F.aggregate(F.filter(F.split(as_, ""), lambda c: c != ""), start, place, lambda s: s["out"])


def _iban(m: Column, key: Column) -> Column:
    """The country stays. The pseudonym is that of the number, however it is printed, in the same print."""
    own, land = _compact(m), F.substring(m, 1, 2)
    made = lambda body: F.concat(land, F.lpad((98 - _mod97(F.concat(land, F.lit("00"), body))).cast("string"), 2, "0"), body)
    return _once(_once(permuted(F.substring(own, F.lit(5), F.length(own)), key, "iban"), made), lambda new: _laid_out(new, m))


def _ip6(m: Column, key: Column) -> Column:
    """Its hexadecimal digits are moved, its colons stay; letters are as large as they were, small if there were none."""
    digits = F.lower(F.replace(m, F.lit(":"), F.lit("")))
    letters = F.translate(digits, "0123456789abcdef", "abcdefghijklmnop")
    cut = F.floor(F.length(letters) / 2).cast("int")
    own = F.concat(key, F.lit("ip6"))

    def moved(half: Column, noise: Column) -> Column:
        return _once(noise, lambda n: shifted(half, n))

    def shifted(half: Column, noise: Column) -> Column:
        by = lambda i: F.conv(F.substring(noise, 2 * F.pmod(i - 1, F.lit(32)) + 1, F.lit(2)), 16, 10).cast("int")
        places = F.when(F.length(half) > 0, F.sequence(F.lit(1), F.length(half))).otherwise(F.array().cast("array<int>"))
        return F.array_join(F.transform(places, lambda i: F.char(97 + F.pmod(F.ascii(F.substring(half, i, F.lit(1))) - 97 + by(i), F.lit(16)))), "")

    def turn(s, i):
        even = F.pmod(i, F.lit(2)) == 0
        return F.struct(F.when(even, moved(s["l"], _noise(own, i, s["r"]))).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(moved(s["r"], _noise(own, i, s["l"]))).alias("r"))

    start = F.struct(F.substring(letters, F.lit(1), cut).alias("l"), F.substring(letters, cut + 1, F.length(letters)).alias("r"))
    new = F.translate(F.aggregate(F.sequence(F.lit(0), F.lit(TURNS - 1)), start, turn, lambda s: F.concat(s["l"], s["r"])), "abcdefghijklmnop", "0123456789abcdef")
    laid = _once(new, lambda x: F.replace(_laid_out(x, F.replace(m, F.lit(":"), F.lit("-"))), F.lit("-"), F.lit(":")))
    return F.when(m.rlike("[A-F]"), F.upper(laid)).otherwise(laid)


def _ssn_valid(m: Column) -> Column:
    return m.rlike(r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$")


def _ssn(m: Column, key: Column) -> Column:
    """Again and again until the outcome is valid itself (one in nine isn't), so the valid numbers are permuted."""
    again = lambda x, _: F.when(_ssn_valid(x), x).otherwise(permuted(x, key, "ssn"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(24)), permuted(m, key, "ssn"), again)


def _phone(m: Column, key: Column) -> Column:
    """The country code stays."""
    land = F.regexp_extract(m, r"^(\+\d{1,3}(?=[ .(-]))", 1)
    return F.concat(land, permuted(F.substring(m, F.length(land) + 1, F.length(m)), key, "phone"))


def _ip(m: Column, key: Column) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    s = permuted_number(o[0] * 256 + o[1], o[2] * 256 + o[3], key, "ip", 65536, 65536)
    quads = lambda s: F.concat_ws(".", *(f.cast("string") for f in (F.floor(s["l"] / 256), F.pmod(s["l"], F.lit(256)), F.floor(s["r"] / 256), F.pmod(s["r"], F.lit(256)))))
    return F.element_at(F.transform(F.array(s), quads), 1)


def _day(m: Column) -> Column:
    """The date that m names, day before month unless only the other order is one; null if none or out of range."""
    p = F.split(m, "[./-]")
    iso = F.concat_ws("-", p[0], p[1], p[2])
    made = lambda d, mo: F.concat_ws("-", p[2], F.lpad(mo, 2, "0"), F.lpad(d, 2, "0"))
    day = F.when(m.contains("-"), iso.try_cast("date")).otherwise(F.coalesce(made(p[0], p[1]).try_cast("date"), made(p[1], p[0]).try_cast("date")))
    return F.when(day.between(F.lit(FIRST), F.lit(LAST)), day)


def _date(m: Column, key: Column) -> Column:
    """Another date in the same order, its day and month as wide as they were: one digit stays one digit."""
    day, p = _day(m), F.split(m, "[./-]")
    iso = m.contains("-")
    turned = ~iso & F.concat_ws("-", p[2], F.lpad(p[1], 2, "0"), F.lpad(p[0], 2, "0")).try_cast("date").isNull()
    wide = lambda i: F.lit(True) if i is None else F.length(p[i]) == 2
    day_wide = iso | F.when(turned, wide(1)).otherwise(wide(0))
    month_wide = iso | F.when(turned, wide(0)).otherwise(wide(1))
    days, months = F.when(day_wide, F.lit(31)).otherwise(F.lit(9)), F.when(month_wide, F.lit(12)).otherwise(F.lit(9))
    years = LAST.year - FIRST.year + 1
    start = F.struct((F.day(day) - 1).cast("long").alias("l"), ((F.year(day) - FIRST.year) * months + F.month(day) - 1).cast("long").alias("r"))
    turn = lambda s: permuted_number(s["l"], s["r"], key, "date", days, months * years)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    part = lambda s: (s["l"] + 1, F.pmod(s["r"], months.cast("long")) + 1, F.floor(s["r"] / months) + FIRST.year)

    def valid(s):
        d, mo, y = part(s)
        return F.concat_ws("-", y.cast("string"), two(mo), two(d)).try_cast("date").isNotNull()

    def shown(s):
        d, mo, y = part(s)
        d, mo, y = F.when(day_wide, two(d)).otherwise(d.cast("string")), F.when(month_wide, two(mo)).otherwise(mo.cast("string")), y.cast("string")
        sep = F.regexp_extract(m, "[./]", 0)
        return F.when(iso, F.concat_ws("-", y, mo, d)).when(turned, F.concat(mo, sep, d, sep, y)).otherwise(F.concat(d, sep, mo, sep, y))

    # again until there is such a day (at least 9 in 10 are one), so the dates of a width are permuted
    return F.aggregate(F.sequence(F.lit(1), F.lit(24)), turn(start), lambda s, _: F.when(valid(s), s).otherwise(turn(s)), shown)


def _email(m: Column, key: Column) -> Column:
    return F.concat(permuted(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


def _hidden(m: Column, key: Column) -> Column:
    """Names and quotes stay; the value is permuted."""
    name = F.regexp_extract(m, r"(?i)^((?:password|passwd|pwd|secret|token|api[_-]?key)\s{0,2}[=:]\s{0,2}[\"']?|AKIA)", 1)
    return F.concat(name, permuted(F.substring(m, F.length(name) + 1, F.length(m)), key, "secret"))


def kind_of(m: Column) -> Column:
    """The format that m is in and valid for; null if none."""
    is_ = lambda k: m.rlike(f"^(?:{FORMATS[k]})$")
    octets = F.forall(F.split(m, r"\."), lambda x: x.cast("int") < 256)
    card = F.length(_digits(m)).between(13, 19) & F.call_function("luhn_check", _digits(m))
    out = F.when(is_("email"), "email").when(is_("secret"), "secret").when(is_("iban") & (F.when(is_("iban"), _mod97(_compact(m))) == 1), "iban")
    out = out.when(is_("ip6") & (F.size(F.filter(F.split(m, ":"), lambda x: x != "")) <= F.when(m.contains("::"), 7).otherwise(8)), "ip6")
    out = out.when(is_("ip") & F.when(is_("ip"), octets), "ip").when(is_("date") & F.when(is_("date"), _day(m).isNotNull()), "date")
    return out.when(_ssn_valid(m), "ssn").when(is_("card") & card, "card").when(is_("phone"), "phone")


def pseudonym(m: Column, kind: Column, key: Column) -> Column:
    out = None
    for name, make in {"email": _email, "secret": _hidden, "iban": _iban, "ip6": _ip6, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}.items():
        out = F.when(kind == name, make(m, key)) if out is None else out.when(kind == name, make(m, key))
    return out.otherwise(m)


def _valid_cards(text: Column) -> Column:
    """The valid cards of a text, looked for at every place and in every length, the likelier reading first."""
    seen = lambda p: F.regexp_extract_all(text, F.lit(rf"(?<!\d)(?=({p})(?!\d))"), F.lit(1))
    return F.filter(F.array_distinct(F.concat(*map(seen, PRINTED + OTHER))), lambda m: F.call_function("luhn_check", _digits(m)))


def pattern_of(text: Column) -> Column:
    """ANY for this text. A candidate that fails its check hides no valid card beside or within it."""
    cards = F.array_join(_valid_cards(text), "|")
    filled = F.transform(F.array(cards), lambda c: F.when(c == "", F.lit(NO_CARDS)).otherwise(F.replace(F.lit(ANY), F.lit(CARDS), c)))
    return F.when(text.rlike(RUN), F.element_at(filled, 1)).otherwise(F.lit(NO_CARDS))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with the text's private values replaced under the key; all other columns stay as they are, whatever their
    names. count_col, if named, gets the number of values and replaces a column of this name.

    No shuffle. A null text stays null and an empty one empty, both count none; a text of any length is searched whole.
    Numbers that fail their check, and values in no format of FORMATS (names, addresses), are left alone. Repeated rows
    are treated alike, an empty table stays empty.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    text, secret = F.col(f"`{text_col}`"), _secret(key)
    live = text.rlike(GATE)
    pattern, found = fresh(docs, "pattern"), fresh(docs, "found")
    d = docs.withColumn(pattern, F.when(live, pattern_of(text)))
    hits = F.when(live, F.regexp_extract_all(text, F.col(pattern), F.lit(0)))
    d = d.withColumn(found, F.transform(hits, lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind"))))
    any_ = F.exists(found, lambda x: x["kind"].isNotNull())
    new = F.transform(found, lambda x: pseudonym(x["m"], x["kind"], secret))
    joined = F.array_join(F.zip_with(F.split(text, F.col(pattern), -1), F.concat(new, F.array(F.lit(""))), lambda gap, value: F.concat(gap, value)), "")
    out = d.withColumn(text_col, F.when(F.coalesce(any_, F.lit(False)), joined).otherwise(text))
    if count_col:
        out = out.withColumn(count_col, F.coalesce(F.size(F.filter(found, lambda x: x["kind"].isNotNull())), F.lit(0)).cast("long"))
        out = out.withColumn(count_col, F.greatest(F.col(count_col), F.lit(0)))
    return out.drop(found, pattern)


def report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, n_values (private values replaced), text."""
    out = pseudonymise(docs.select("doc_id", text_of().alias("text")), key, count_col="n_values")
    return out.select("doc_id", "n_values", "text")
