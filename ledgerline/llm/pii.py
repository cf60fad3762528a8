"""Format-preserving pseudonyms for personal data, with built-in functions only.

One pattern finds candidates; each kind then has its own validity test (Luhn, mod 97, octets, calendar, number plan).  A valid
value is mapped to a number, or a pair of numbers, in the domain of its format and permuted there by a keyed Feistel network with
modular addition, so the result is valid too, equal values get equal pseudonyms in every document, and different values differ.
Separators stay where they were.  The key is a parameter; it appears in query plans, so plans must be kept as private as the key.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")
ROUNDS = 8

# The formats that are searched for.
_EMAIL = r"(?<!\.)[\w.%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
_IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_IP = r"(?<!\d\.)(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
_DATE = r"(?:\d{4}(?<a>[-/.])\d{1,2}\k<a>\d{1,2}|\d{1,2}(?<b>[-/.])\d{1,2}\k<b>\d{4})(?!\d)"
_SSN = r"\d{3}-\d{2}-\d{4}(?![\d-])"
_PHONE = r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4})(?!\d)"
_CARD = r"\d(?:[ -]?\d){12,18}(?!\d)"
PATTERN = rf"(?<![\w%+-])(?:{_EMAIL}|{_IBAN}|{_IP}|{_DATE}|{_SSN}|{_PHONE}|{_CARD})"
#: Lengths of account numbers by country; other countries may have any.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30,
    "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20}
#: Values of a text that are put in order at once.
BLOCK = 500


def _whole(pattern: str) -> str:
    return rf"^(?:{pattern})$"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _prf(key: str, tag: str, i: Column, x: Column) -> Column:
    """Keyed 60-bit value of ``x`` in round ``i``."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), i, x), 256), 1, 15), 16, 10).cast("bigint")


def feistel(key: str, tag: str, left: Column, right: Column, a: Column | int, b: Column | int) -> Column:
    """Permutation of the pairs (left below ``a``, right below ``b``): each side is shifted in turn by a keyed value of the other."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("bigint") for x in (a, b))
    begin = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    def step(s, i):
        odd = F.struct(((s["l"] + _prf(key, tag, i, s["r"])) % a).alias("l"), s["r"].alias("r"))
        even = F.struct(s["l"].alias("l"), ((s["r"] + _prf(key, tag, i, s["l"])) % b).alias("r"))
        return F.when(i % 2 == 1, odd).otherwise(even)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, step)


def _permute_digits(key: str, tag: str, d: Column) -> Column:
    """Permutation of the digit strings of the length of ``d``, two digits at least."""
    n = F.length(d)
    u = n - F.floor(n / 2).cast("int")
    out = feistel(key, tag, F.substring(d, F.lit(1), u), F.substring(d, u + 1, n), F.pow(F.lit(10.0), u).cast("bigint"), F.pow(F.lit(10.0), n - u).cast("bigint"))
    return F.transform(F.array(out), lambda s: F.concat(F.lpad(s["l"].cast("string"), u, F.lit("0")), F.lpad(s["r"].cast("string"), n - u, F.lit("0"))))[0]


def _refill(x: Column, digits: Column) -> Column:
    """``x`` with its digits replaced in order; everything else stays at its place."""
    begin = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(s, c):
        is_digit = c.between("0", "9")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substring(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"), F.when(is_digit, s["k"] + 1).otherwise(s["k"]).alias("k"))

    return F.aggregate(F.split(x, ""), begin, step, lambda s: s["out"])


def _luhn(d: Column) -> Column:
    """Luhn sum of ``d``, whose last digit is the check digit."""
    n = F.length(d)

    def step(acc, i):
        v = F.substring(d, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return acc + F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step)


def _mod97(x: Column) -> Column:
    """Remainder of the number that ``x`` spells, with letters as 10 to 35."""
    def step(acc, c):
        return F.when(c.between("0", "9"), (acc * 10 + (F.ascii(c) - 48)) % 97).otherwise((acc * 100 + (F.ascii(c) - 55)) % 97)

    return F.aggregate(F.split(x, ""), F.lit(0), step)


def _iban_turned(flat: Column, check: Column) -> Column:
    return F.concat(F.substring(flat, F.lit(5), F.length(flat)), F.substring(flat, 1, 2), check)


def _as_date(x: Column) -> Column:
    """The date that ``x`` names; day before month unless only the other order is a date."""
    sep = F.regexp_replace(x, "[/.]", "-")
    parse = lambda f: F.try_to_timestamp(sep, F.lit(f)).cast("date")
    return F.when(x.rlike(r"^\d{4}"), parse("yyyy-M-d")).otherwise(F.coalesce(parse("d-M-yyyy"), parse("M-d-yyyy")))


def kind_of(x: Column) -> Column:
    """Kind of a candidate, or NULL if it isn't valid."""
    d = _digits(x)
    flat = F.regexp_replace(x, " ", "")
    ssn = (~d.rlike("^(000|666|9)")) & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")
    ip = ~F.exists(F.split(x, r"\."), lambda o: o.cast("int") > 255)
    return (F.when(x.contains("@"), F.lit("email"))
            .when(x.rlike(_whole(_IP)), F.when(ip, F.lit("ip")))
            .when(x.rlike(_whole(_DATE)), F.when(_as_date(x).isNotNull(), F.lit("date")))
            .when(x.rlike(_whole(_SSN)), F.when(ssn, F.lit("ssn")))
            .when(x.rlike(_whole(_IBAN)), F.when((_mod97(_iban_turned(flat, F.substring(flat, 3, 2))) == 1) & (F.length(_digits(F.substring(flat, F.lit(5), F.length(flat)))) >= 2), F.lit("iban")))
            .when(x.rlike(_whole(_PHONE)), F.lit("phone"))
            .when(x.rlike(_whole(_CARD)) & (_luhn(d) % 10 == 0), F.lit("card")))


def value_in(x: Column) -> Column:
    """``kind`` and ``text`` of the valid value that a candidate begins with; without one the kind is NULL, and ``text`` what to pass over.

    The pattern takes as much as it can, so a number or a word in capitals behind a card or IBAN may be part of the candidate.  What
    ends at a group's end is tried, the longest first, an IBAN of its country's length before all others.  An IBAN of that length with
    wrong check digits is passed over, so its digits are not taken for a card.
    """
    size = F.length(x)
    value = lambda kind, text: F.struct(kind.alias("kind"), text.alias("text"))
    ends = F.filter(F.sequence(size, F.least(size, F.lit(12)), F.lit(-1)), lambda n: (n == size) | F.substring(x, n + 1, F.lit(1)).isin(" ", "-"))
    starts = F.transform(ends, lambda n: F.substring(x, F.lit(1), n))
    wanted = F.element_at(F.create_map(*[F.lit(v) for kv in IBAN_LENGTHS.items() for v in kv]), F.substring(x, 1, 2))
    right = lambda t: F.coalesce(F.length(F.regexp_replace(t, " ", "")) == wanted, F.lit(False))
    first = lambda tried, kind: F.try_element_at(F.filter(F.transform(tried, lambda t: value(kind_of(t), t)), lambda v: v["kind"] == kind), F.lit(1))
    iban = first(F.concat(F.filter(starts, right), F.filter(starts, lambda t: ~right(t))), "iban")
    whole = F.transform(F.array(x), lambda t: value(kind_of(t), t))[0]
    found = F.when(x.rlike(_whole(_IBAN)), iban).when(x.rlike(_whole(_CARD)), F.transform(F.array(whole), lambda w: F.when(w["kind"].isNotNull(), w).otherwise(first(starts, "card")))[0]).otherwise(whole)
    over = value(F.lit(None).cast("string"), F.when(x.rlike(_whole(_IBAN)), F.try_element_at(F.filter(starts, right), F.lit(1))))
    return F.transform(F.array(found), lambda v: F.when(v["kind"].isNotNull(), v).otherwise(over))[0]


def _passed(sizes: Column, lengths: Column) -> Column:
    """How much of each piece a value of an earlier piece takes; ``sizes`` are those of the values that the pieces begin with, or 0."""
    each = F.zip_with(sizes, lengths, lambda s, n: F.struct(s.alias("s"), n.alias("n")))

    def one(state, p):
        s, n = p["s"], p["n"]
        reach = F.when(state["left"] > 0, state["left"]).otherwise(s)
        return F.struct(F.greatest(reach - n, F.lit(0)).alias("left"), F.array_append(state["out"], state["left"]).alias("out"))

    def block(state, i):
        begin = F.struct(state["left"].alias("left"), F.array().cast("array<int>").alias("out"))
        done = F.aggregate(F.slice(each, i, F.lit(BLOCK)), begin, one)
        return F.transform(F.array(done), lambda d: F.struct(d["left"].alias("left"), F.array_append(state["out"], d["out"]).alias("out")))[0]

    begin = F.struct(F.lit(0).alias("left"), F.array().cast("array<array<int>>").alias("out"))
    blocks = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(sizes), F.lit(1)), F.lit(BLOCK)), begin, block, lambda s: F.flatten(s["out"]))
    return F.when(F.exists(each, lambda p: p["s"] > p["n"]), blocks).otherwise(F.transform(sizes, lambda s: F.lit(0)))


def _email(key: str, x: Column) -> Column:
    """Letters and digits of the local part are shifted within their class; the domain stays."""
    local = F.substring_index(x, "@", 1)
    n = F.length(local)
    u = n - F.floor(n / 2).cast("int")

    def shifted(half, other, i):
        blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.length(half) - 1, F.lit(0)) / 32).cast("int"))
        stream = F.array_join(F.transform(blocks, lambda block: F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), i, block, other), 256)), "")

        def moved(c, s):
            move = lambda first, size: F.char(F.lit(first) + (F.ascii(c) - first + s) % size)
            return F.when(c.between("a", "z"), move(97, 26)).when(c.between("A", "Z"), move(65, 26)).when(c.between("0", "9"), move(48, 10)).otherwise(c)

        # one hash for every 32 characters, made once: a shift is two of its hexadecimal digits
        shifts = F.transform(F.regexp_extract_all(stream, F.lit("(..)"), 1), lambda h: F.conv(h, 16, 10).cast("int"))
        return F.array_join(F.zip_with(F.split(half, ""), F.slice(shifts, F.lit(1), F.greatest(F.length(half), F.lit(1))), moved), "")

    def step(s, i):
        return F.when(i % 2 == 1, F.struct(shifted(s["l"], s["r"], i).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), shifted(s["r"], s["l"], i).alias("r")))

    begin = F.struct(F.substring(local, F.lit(1), u).alias("l"), F.substring(local, u + 1, n).alias("r"))
    out = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, step, lambda s: F.concat(s["l"], s["r"]))
    return F.concat(out, F.substring(x, n + 1, F.length(x)))


def _ip(key: str, x: Column) -> Column:
    o = lambda i: F.element_at(F.split(x, r"\."), i).cast("bigint")
    out = feistel(key, "ip", o(1) * 256 + o(2), o(3) * 256 + o(4), 65536, 65536)
    return F.transform(F.array(out), lambda s: F.concat_ws(".", *[F.floor(s[h] / 256).cast("int") if high else (s[h] % 256).cast("int") for h in ("l", "r") for high in (True, False)]))[0]


def _date(key: str, x: Column) -> Column:
    """Another date of the same hundred years, written in the same order.

    A day over 12 becomes one over 12 and a day up to 12 one up to 12, so what can be read in one order only stays so, and results of
    the two orders never meet.  Days of a hundred years are 75 x 487 or, without a leap century, 92 x 397; dates with a day up to 12 are 120 x 120.
    """
    day = _as_date(x)
    first_year = F.floor((F.year(day) - 1930) / 100).cast("int") * 100 + 1930
    start = F.make_date(first_year, F.lit(1), F.lit(1))
    long = F.datediff(F.make_date(first_year + 100, F.lit(1), F.lit(1)), start) == 36525
    a, b = F.when(long, 75).otherwise(92).cast("bigint"), F.when(long, 487).otherwise(397).cast("bigint")
    number = lambda d: F.datediff(d, start).cast("bigint")

    def permuted(tag: str, n: Column) -> Column:
        return F.transform(F.array(feistel(key, tag, F.floor(n / b), n % b, a, b)), lambda s: s["l"] * b + s["r"])[0]

    # the first day over 12 that repeated permuting comes to; more than 63 steps have a chance of 1e-25
    step = lambda n, i: F.when((i > 1) & (F.dayofmonth(F.date_add(start, n.cast("int"))) > 12), n).otherwise(permuted("date", n))
    late = F.date_add(start, F.aggregate(F.sequence(F.lit(1), F.lit(64)), number(day), step).cast("int"))
    early = (F.year(day) - first_year) * 144 + (F.month(day) - 1) * 12 + F.dayofmonth(day) - 1
    pair = feistel(key, "date-both", F.floor(early / 120), early % 120, 120, 120)
    both = F.transform(F.transform(F.array(pair), lambda s: (s["l"] * 120 + s["r"]).cast("int")), lambda n: F.make_date(first_year + F.floor(n / 144).cast("int"), (F.floor(n / 12) % 12 + 1).cast("int"), n % 12 + 1))[0]
    dmy = F.try_to_timestamp(F.regexp_replace(x, "[/.]", "-"), F.lit("d-M-yyyy")).isNotNull()
    ymd = x.rlike(r"^\d{4}")
    new = F.when(F.dayofmonth(day) <= 12, both).otherwise(late)
    sep = F.regexp_extract(x, r"^\d+(\D)", 1)
    two = lambda v, short: F.when(short, v.cast("string")).otherwise(F.lpad(v.cast("string"), 2, "0"))
    short = x.rlike(r"(^|\D)[1-9](\D|$)")

    def written(date: Column) -> Column:
        d, m, y = two(F.dayofmonth(date), short), two(F.month(date), short), F.year(date).cast("string")
        return F.when(ymd, F.concat(y, sep, m, sep, d)).when(dmy, F.concat(d, sep, m, sep, y)).otherwise(F.concat(m, sep, d, sep, y))

    return F.transform(F.array(new), written)[0]


def _ssn(key: str, x: Column) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    d = _digits(x)
    area = F.substring(d, 1, 3).cast("int")
    left = area - 1 - F.when(area > 666, 1).otherwise(0)
    right = (F.substring(d, 4, 2).cast("bigint") - 1) * 9999 + F.substring(d, 6, 4).cast("bigint") - 1
    out = feistel(key, "ssn", left, right, 898, 99 * 9999)

    def text(s):
        area = s["l"] + 1 + F.when(s["l"] >= 665, 1).otherwise(0)
        pad = lambda v, n: F.lpad(v.cast("bigint").cast("string"), n, "0")
        return F.concat_ws("-", pad(area, 3), pad(F.floor(s["r"] / 9999) + 1, 2), pad(s["r"] % 9999 + 1, 4))

    return F.transform(F.array(out), text)[0]


def _phone(key: str, x: Column) -> Column:
    """Ten-digit plan: area and exchange keep a first digit of 2 to 9; else every digit after the first."""
    d = _digits(x)
    plan = d.rlike(r"^1?[2-9]\d{2}[2-9]\d{6}$") & (F.length(d).isin(10, 11)) & (x.startswith("+1") | ~x.startswith("+"))
    ten = F.substring(d, -10, 10)
    three = lambda i: F.substring(ten, i, 3).cast("bigint") - 200
    out = feistel(key, "phone", three(1), three(4) * 10000 + F.substring(ten, 7, 4).cast("bigint"), 800, 8_000_000)
    new = F.transform(F.array(out), lambda s: F.concat((s["l"] + 200).cast("string"), (F.floor(s["r"] / 10000) + 200).cast("string"), F.lpad((s["r"] % 10000).cast("string"), 4, "0")))[0]
    planned = F.concat(F.when(F.length(d) == 11, F.lit("1")).otherwise(F.lit("")), new)
    loose = F.concat(F.substring(d, 1, 1), _permute_digits(key, "phone-any", F.substring(d, F.lit(2), F.length(d))))
    return _refill(x, F.when(plan, planned).otherwise(loose))


def _card(key: str, x: Column) -> Column:
    """First digit kept, payload permuted, check digit made anew."""
    d = _digits(x)
    payload = F.concat(F.substring(d, 1, 1), _permute_digits(key, "card", F.substring(d, F.lit(2), F.length(d) - 2)))
    return _refill(x, F.transform(F.array(payload), lambda p: F.concat(p, ((10 - _luhn(F.concat(p, F.lit("0"))) % 10) % 10).cast("string")))[0])


def _iban(key: str, x: Column) -> Column:
    """Digits of the account part permuted, check digits made anew."""
    flat = F.regexp_replace(x, " ", "")
    account = F.substring(flat, F.lit(5), F.length(flat))
    new = _refill(account, _permute_digits(key, "iban", _digits(account)))

    def text(body):
        whole = F.concat(F.substring(flat, 1, 2), F.lit("00"), body)
        check = F.lpad((98 - _mod97(_iban_turned(whole, F.lit("00")))).cast("string"), 2, F.lit("0"))
        return F.concat(check, _digits(body))

    return _refill(x, F.transform(F.array(new), text)[0])


def pseudonym(key: str, kind: Column, x: Column) -> Column:
    out = F.when(kind.isNull(), x)
    for name, make in (("email", _email), ("iban", _iban), ("ip", _ip), ("date", _date), ("ssn", _ssn), ("phone", _phone), ("card", _card)):
        out = out.when(kind == name, make(key, x))
    return out


def with_pseudonyms(docs: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; ``found`` names an added array of (kind, text) of what was replaced.

    All other columns stay.  A NULL text stays NULL, an empty one empty; candidates without a valid value stay as they are, and are
    searched from their next word on; repeated rows get the same result.  Every row is handled by itself, so there is no shuffle.
    """
    columns, rest, hits, passed = docs.columns, "__pii_rest", "__pii_hits", "__pii_passed"
    # a text is cut before each place where a candidate begins, so candidates may overlap; the first that is valid goes
    parts = docs.withColumns({rest: F.split(F.col(text), rf"(?={PATTERN})", -1), hits: F.coalesce(F.regexp_extract_all(F.col(text), F.lit(rf"(?=({PATTERN}))"), 1), F.array().cast("array<string>"))})
    parts = parts.withColumn(hits, F.transform(hits, value_in))
    body = F.slice(rest, F.size(rest) - F.size(hits) + 1, F.size(hits))
    size = F.transform(hits, lambda h: F.coalesce(F.length(h["text"]), F.lit(0)))
    parts = parts.withColumn(passed, _passed(size, F.transform(body, lambda p: F.length(p))))
    parts = parts.withColumn(hits, F.zip_with(hits, passed, lambda h, n: F.when(n == 0, h)))

    def piece(p, i):
        h = F.col(hits)[i]
        taken = F.when(F.col(passed)[i] > 0, F.col(passed)[i]).otherwise(F.coalesce(F.length(h["text"]), F.lit(0)))
        return F.concat(F.coalesce(pseudonym(key, h["kind"], h["text"]), F.lit("")), F.substring(p, taken + 1, F.length(p)))

    head = F.when(F.size(rest) > F.size(hits), F.col(rest)[0]).otherwise("")
    out = parts.withColumn(text, F.when(F.size(hits) > 0, F.concat(head, F.array_join(F.transform(body, piece), ""))).otherwise(F.col(text)))
    extra = [] if found is None else [F.filter(hits, lambda h: h["kind"].isNotNull()).alias(found)]
    return out.select(*[F.col(f"`{c}`") for c in columns], *extra)
