"""Pseudonyms for personal numbers, addresses and dates: keyed Feistel permutations within each format.

Everything is DataFrame functions. A value is found by pattern, validated, permuted by a Feistel network over its own
format and written back with its separators, so equal values get equal pseudonyms in every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.storage import whole_text

ROUNDS = 10
#: Patterns by kind, tried in this order at each place.
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "date": r"(?<![\w.\-/])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{4}\.\d{2}\.\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}|\d{2}-\d{2}-\d{4})(?![\w\-/])(?!\.\d)",
    "ip": r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w)(?!\.\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]\d{4}(?!\w)|(?<![\w+])\+\d{8,15}(?!\w)",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "card": r"(?<![\w])(?:\d{13,19}|\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\w)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
}
#: "dddd dddd dddd dddd" also fits the pattern of a phone, so cards in groups come before phones.
_ORDER = ("email", "date", "ip", "card", "ssn", "phone", "iban")
_ALL = "|".join(f"(?:{PATTERNS[k]})" for k in _ORDER)
KINDS = _ORDER
#: Days of a whole Gregorian cycle from 1800-01-01, as a product of two radixes.
_DAYS, _DAY_LEFT, _DAY_RIGHT = 146_097, 189, 773


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digest(key: str, kind: str, number: Column, other: Column) -> Column:
    """The keyed round function, as hexadecimal digits."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), number.cast("string"), other), 256)


def _part(digest: Column, at: Column | int, n: int) -> Column:
    start = at if isinstance(at, Column) else F.lit(at)
    return F.conv(F.substring(digest, start, F.lit(n)), 16, 10).cast("long")


#: First code point and number of letters of the runs within which a letter moves.
_LETTERS = (
    (0x30, 10), (0x41, 26), (0x61, 26), (0xC0, 23), (0xD8, 7), (0xDF, 24), (0xF8, 8), (0x100, 128), (0x391, 17), (0x3A3, 7),
    (0x3B1, 25), (0x410, 32), (0x430, 32), (0x450, 16), (0x531, 38), (0x561, 38), (0x5D0, 27), (0x620, 43), (0x904, 54), (0xE01, 46),
    (0x10D0, 43), (0x3041, 86), (0x30A1, 90), (0x4E00, 20_902), (0xAC00, 11_172),
)


def _shifted(c: Column, by: Column) -> Column:
    """A digit or letter moved within its run of letters, so that its script and, where it has one, its case stay."""
    code, run = F.ascii(c), F.lit(None).cast("struct<first:int,size:int>")
    for first, size in reversed(_LETTERS):
        run = F.when(code.between(first, first + size - 1), F.struct(F.lit(first).alias("first"), F.lit(size).alias("size"))).otherwise(run)

    def letter(x: Column) -> Column:
        return F.when(x < 0x80, F.char(x)).otherwise(F.decode(F.unhex(F.lpad(F.hex(x), 4, "0")), "UTF-16BE"))

    return F.coalesce(_let(run, lambda r: _let(r["first"] + (code - r["first"] + by) % r["size"], letter)), c)


def _in_format(m: Column, sign: str, new: Column) -> Column:
    """``m`` with its characters that match ``sign`` replaced, one after another, by those of ``new``."""
    return _let(F.struct(F.split(m, sign, -1).alias("gaps"), new.alias("new")), lambda x: F.when(x["new"].isNotNull(), F.array_join(
        F.zip_with(x["gaps"], F.concat(_chars_of(x["new"]), F.array(F.lit(""))), lambda gap, c: F.concat(gap, c)), ""
    )))


def _chars_of(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)))


def permuted(s: Column, key: str, kind: str) -> Column:
    """Feistel over the two halves of a short string; every character stays in its class, separators stay."""

    def moved(half: Column, other: Column, number: Column) -> Column:
        shifted = _let(_digest(key, kind, number, other), lambda digest: F.transform(
            _chars_of(half), lambda c, i: _shifted(c, _part(digest, i % 31 * 2 + 1, 2))
        ))
        return F.when(F.length(half) == 0, F.lit("")).otherwise(F.array_join(shifted, ""))

    def step(state: Column, number: Column) -> Column:
        middle = F.floor(F.length(state) / 2).cast("int")
        left = F.substring(state, F.lit(1), middle)
        right = F.substring(state, middle + 1, F.length(state))
        return F.when(number % 2 == 0, F.concat(moved(left, right, number), right)).otherwise(
            F.concat(left, moved(right, left, number))
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), s, step)


def permuted_number(value: Column, left_size: int, right_size: int, key: str, kind: str) -> Column:
    """Feistel over the whole numbers below ``left_size * right_size``."""
    start = F.struct(
        F.floor(value / right_size).cast("long").alias("l"), (value % right_size).cast("long").alias("r")
    )

    def step(state: Column, number: Column) -> Column:
        l, r = state["l"], state["r"]
        new_l = (l + _part(_digest(key, kind, number, r.cast("string")), 1, 12)) % left_size
        new_r = (r + _part(_digest(key, kind, number, l.cast("string")), 1, 12)) % right_size
        even = number % 2 == 0
        return F.struct(F.when(even, new_l).otherwise(l).alias("l"), F.when(even, r).otherwise(new_r).alias("r"))

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * right_size + s["r"]
    )


def _luhn(digits: Column, from_right: int) -> Column:
    """The checksum of the digits; the last one counts as place ``from_right`` from the right."""
    places = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.struct(
        F.substring(digits, i, F.lit(1)).cast("int").alias("d"),
        ((F.length(digits) - i + from_right) % 2).alias("odd"),
    ))
    return F.aggregate(places, F.lit(0), lambda total, p: total + F.when(
        p["odd"] == 1, p["d"] * 2 - F.when(p["d"] > 4, F.lit(9)).otherwise(F.lit(0))
    ).otherwise(p["d"]))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _card(m: Column, key: str) -> Column:
    """Null unless the Luhn sum holds; the new check digit makes it hold again."""

    def new(digits: Column) -> Column:
        body = _let(permuted(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card"), lambda body: F.concat(
            body, ((F.lit(10) - _luhn(body, 1) % 10) % 10).cast("string")
        ))
        return F.when(_luhn(digits, 0) % 10 == 0, body)

    return _in_format(m, "[0-9]", _let(_digits(m), new))


def _rest97(s: Column) -> Column:
    """A string of digits and capital letters (A = 10 to Z = 35) as a number modulo 97."""
    return F.aggregate(_chars_of(s), F.lit(0), lambda rest, c: F.when(
        F.ascii(c) > 57, (rest * 100 + F.ascii(c) - 55) % 97
    ).otherwise((rest * 10 + F.ascii(c) - 48) % 97))


def _iban(m: Column, key: str) -> Column:
    def new(plain: Column) -> Column:
        country, tail = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
        valid = (_rest97(F.concat(tail, F.substring(plain, 1, 4))) == 1) & (F.length(plain) >= 15)
        return F.when(valid, _let(permuted(tail, key, "iban"), lambda body: F.concat(
            country, F.lpad((F.lit(98) - _rest97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0"), body
        )))

    return _in_format(m, "[A-Z0-9]", _let(F.replace(m, F.lit(" "), F.lit("")), new))


def _ip(m: Column, key: str) -> Column:
    def back(value: Column) -> Column:
        return F.array_join(F.transform(
            F.array(F.lit(16_777_216), F.lit(65_536), F.lit(256), F.lit(1)),
            lambda unit: (F.floor(value / unit).cast("long") % 256).cast("string"),
        ), ".")

    def new(octets: Column) -> Column:
        value = F.aggregate(octets, F.lit(0).cast("long"), lambda total, x: total * 256 + x)
        return F.when(F.forall(octets, lambda x: x <= 255), _let(
            _let(value, lambda v: permuted_number(v, 65_536, 65_536, key, "ip")), back
        ))

    return _let(F.transform(F.split(m, r"\."), lambda x: x.cast("long")), new)


def _is_day(year: Column, month: Column, day: Column) -> Column:
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    longest = F.when(month == 2, F.when(leap, F.lit(29)).otherwise(F.lit(28))).when(
        month.isin(4, 6, 9, 11), F.lit(30)
    ).otherwise(F.lit(31))
    return year.between(1800, 2199) & month.between(1, 12) & day.between(F.lit(1), longest)


def _date(m: Column, key: str) -> Column:
    """Null unless a day from 1800 to 2199. ``mm/dd/yyyy`` has the month first, ``dd.mm.yyyy`` and ``dd-mm-yyyy`` the
    day; if that is no day, the other order is tried."""

    def number(at: int, n: int) -> Column:
        return F.substring(m, at, n).cast("int")

    year_first = m.rlike(r"^\d{4}")
    parts = F.when(year_first, F.struct(
        number(1, 4).alias("y"), number(6, 2).alias("a"), number(9, 2).alias("b"), F.substring(m, 5, 1).alias("sign"),
        F.lit(True).alias("ymd"),
    )).otherwise(F.struct(
        number(7, 4).alias("y"), number(1, 2).alias("a"), number(4, 2).alias("b"), F.substring(m, 3, 1).alias("sign"),
        F.lit(False).alias("ymd"),
    ))
    origin = F.lit("1800-01-01").cast("date")

    def ordered(p: Column) -> Column:
        """Whether the month stands first; null where neither order is a day."""
        month_first, day_first = _is_day(p["y"], p["a"], p["b"]), ~p["ymd"] & _is_day(p["y"], p["b"], p["a"])
        usual = p["ymd"] | (p["sign"] == "/")
        return F.struct(p.alias("p"), F.when(usual & month_first, True).when(~usual & day_first, False).when(
            month_first, True
        ).when(day_first, False).alias("first"))

    def moved(o: Column) -> Column:
        month = F.when(o["first"], o["p"]["a"]).otherwise(o["p"]["b"])
        day = F.when(o["first"], o["p"]["b"]).otherwise(o["p"]["a"])
        number = F.datediff(F.make_date(o["p"]["y"], month, day), origin).cast("long")
        return F.when(o["first"].isNotNull(), F.date_add(origin, _let(
            number, lambda v: permuted_number(v, _DAY_LEFT, _DAY_RIGHT, key, "date")
        ).cast("int")))

    def written(o: Column) -> Column:
        sign = o["p"]["sign"]

        def as_text(day: Column) -> Column:
            y, mm, dd = (F.date_format(day, p) for p in ("yyyy", "MM", "dd"))
            return F.when(o["p"]["ymd"], F.concat(y, sign, mm, sign, dd)).when(
                o["first"], F.concat(mm, sign, dd, sign, y)
            ).otherwise(F.concat(dd, sign, mm, sign, y))

        return _let(moved(o), as_text)

    return _let(_let(parts, ordered), written)


def _phone(m: Column, key: str) -> Column:
    """Seven to fifteen digits; those before the last ten, which are of a country code, stay."""

    def new(digits: Column) -> Column:
        code = F.greatest(F.length(digits) - 10, F.lit(0))
        moved = permuted(F.substring(digits, code + 1, F.length(digits)), key, "phone")
        return F.when(F.length(digits).between(7, 15), F.concat(F.substring(digits, F.lit(1), code), moved))

    return _in_format(m, "[0-9]", _let(_digits(m), new))


def _ssn(m: Column, key: str) -> Column:
    valid = ~m.rlike("^(000|666|9)") & ~m.rlike("-00-") & ~m.rlike("0000$")
    return F.when(valid, _in_format(m, "[0-9]", permuted(_digits(m), key, "ssn")))


def _email(m: Column, key: str) -> Column:
    """The local part changes, in small letters whatever its spelling; the domain stays."""
    local = F.substring_index(m, "@", 1)
    return F.concat(permuted(F.lower(local), key, "email"), F.substring(m, F.length(local) + 1, F.length(m)))


_NEW = {"email": _email, "date": _date, "ip": _ip, "card": _card, "ssn": _ssn, "phone": _phone, "iban": _iban}


def _named(kind: str, new: Column) -> Column:
    return _let(new, lambda value: F.struct(F.when(value.isNotNull(), F.lit(kind)).alias("kind"), value.alias("new")))


def _replacement(m: Column, key: str) -> Column:
    """(kind, new) of a match; kind is null where no validation holds, and the match then stays."""
    pick = F.lit(None).cast("struct<kind:string,new:string>")
    for kind in reversed(_ORDER):
        # a value that its permutation maps to itself is no replacement
        new = _let(_NEW[kind](m, key), lambda value: F.when(value != m, value))
        pick = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), _named(kind, new)).otherwise(pick)
    return pick


def _count(replacements: str, kind: str) -> Column:
    return F.size(F.filter(replacements, lambda r: r["kind"] == kind)).cast("long")


def pseudonymised(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text with pseudonyms, one count ``n_<kind>`` per kind) for every row, in one pass without a shuffle.

    Kinds: card (Luhn), IBAN (modulo 97), IPv4 (four octets), phone (7 to 15 digits), US social security number, date
    (a real day from 1800 to 2199) and e-mail (local part). A value that fails its validation stays. The bare digits or
    letters of a value are permuted and then written into its format, so equal values have equal pseudonyms under one
    key however they are spaced or, in an address, capitalised; a pseudonym is valid again where a check digit or
    calendar says what is valid. Counts are of values that changed. Letters of any script below move within it.

    ``key`` must be kept secret. A null text gives null and zero counts; a null id stays null. Repeated rows give
    repeated results, an empty table none. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    some = whole_text("text").rlike("[0-9@]")
    kind = "array<struct<kind:string,new:string>>"
    found = rows.select(
        "doc_id", "text", F.when(some, F.regexp_extract_all("text", F.lit(_ALL), F.lit(0))).alias("matches"),
    ).select(
        "doc_id", "text", "matches",
        F.when(F.size("matches") > 0, F.transform("matches", lambda m: _replacement(m, key))).otherwise(
            F.array().cast(kind)
        ).alias("new"),
    )
    pieces = F.split("text", _ALL, -1)
    ends = F.concat(
        F.zip_with("matches", "new", lambda m, r: F.coalesce(r["new"], m)), F.array(F.lit(""))
    )
    rebuilt = F.array_join(F.zip_with(pieces, ends, lambda piece, end: F.concat(piece, end)), "")
    return found.select(
        F.col("doc_id").alias(id_col), F.when(F.size("matches") > 0, rebuilt).otherwise(F.col("text")).alias(text_col),
        *[_count("new", k).alias(f"n_{k}") for k in _ORDER],
    )
