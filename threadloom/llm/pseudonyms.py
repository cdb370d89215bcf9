"""Format-preserving pseudonyms for personal numbers and dates, by a keyed Feistel network.

A validated value is moved by a keyed permutation within the values that the rule
which admitted it admits: a card number stays one of its issuer with a right check
digit, a phone number one of its country's plan, a date a real date. Equal values have equal pseudonyms in every document and
different values of a format have different ones. Mail addresses and secrets
have no numeric range; they become keyed digests in the form of an address or a
marker. Columns and SQL functions only.

The permutation works on pairs (x, y) with x in 0..a-1 and y in 0..b-1. A round
replaces (x, y) by (y, x + F(y) mod its range); ten rounds are five of each half.

Null text stays null, empty text and text without such values stays as it is,
at any length. At each place every form is tried at every length that ends with
a group of digits, and the first that is valid is taken; where none is (wrong
check digit, month 13, octet 256), the search goes on with the next group. A
card number in the length and grouping of its issuer goes before any other
reading of its digits; no other one starts with the form of a date or SSN. Of a number with "+" the length that its country's plan
fixes is taken, else the longest: there a number that follows in the next group
cannot be told from the phone. A secret is what follows a key word, in any case
and with any prefix (``DB_PASSWORD=``), up to a space, quote or angle bracket,
however long; below six characters it stays, and so does a plain word after a
colon. There is no key but the one that is set or passed. Every row is returned, repeated ones alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.llm.tables import once, packed

ROUNDS = 10
#: The session setting that names the key; without it and without an argument there is an error.
KEY_SETTING = "threadloom.pii.key"

DATE_BLOCK = (250, 292)  # days a block: dates stay within their block of 73,000 days from 1900-01-01

MAIL = r"[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}"
CLOUD_KEY = r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])"
# After a colon, plain words are prose: a secret has a digit, a change of case or a mark inside.
SECRET = (r"(?i:[A-Z0-9_.\-]*(?:password|passwd|pwd|secret|token|api[_\-]?key))\s{0,3}(?:=\s{0,3}[\"']?"
          r"|:\s{0,3}[\"']?(?=[^\s\"'<>]*(?:\d|[a-z][A-Z]|[^A-Za-z\s\"'<>.,;:!?()\-])))[^\s\"'<>]{6,}+")
IPV4 = r"\d{1,3}(?:\.\d{1,3}){3}(?![0-9])(?!\.\d)"
ISO_DATE = r"\d{4}-\d{2}-\d{2}(?![0-9\-])"
DAY_DATE = r"\d{1,2}(?:\.\d{1,2}\.|/\d{1,2}/)\d{4}(?![0-9])"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
SSN = r"\d{3}-\d{2}-\d{4}(?![0-9\-])"
CARD = r"\d(?:[ \-]?\d){12,18}(?![0-9])"
PHONE_PLUS = r"\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){1,4}(?![0-9])"
PHONE_LOCAL = r"(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[.\-])[2-9]\d{2}[.\-]\d{4}(?![0-9])"

FORMS = {
    "mail": MAIL, "cloud_key": CLOUD_KEY, "secret": SECRET, "iso_date": ISO_DATE, "ipv4": IPV4,
    "day_date": DAY_DATE, "ssn": SSN, "card": CARD, "iban": IBAN,
    "phone": f"{PHONE_PLUS}|{PHONE_LOCAL}",
}
#: Where a value may start, before it; none starts inside a word or number.
PLACE = r"(?<![A-Za-z0-9_.@+\-])(?=" + "|".join(FORMS.values()) + ")"
#: Places lie two characters apart, and no form but mail and secret has more than 46 characters.
WINDOW = 24

# The lengths of a form, longest first.
CARDS = [rf"\d(?:[ \-]?\d){{{n}}}(?![0-9])" for n in range(18, 11, -1)]
IBANS = [rf"[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{{n}}}{tail}(?![0-9A-Za-z])" for n in range(7, 1, -1) for tail in (" ?[A-Z0-9]{1,3}", "")]
PHONES = [rf"\+\d{{1,3}}[ .\-]?(?:\(\d{{1,4}}\)|\d{{1,4}})(?:[ .\-]?\d{{2,4}}){{{n}}}(?![0-9])" for n in range(4, 0, -1)]
#: Length and grouping of the issuers.
ISSUED = (r"^(?:(?:4\d|5[1-5]|2[2-7]|35|6\d)\d\d([ \-]?)\d{4}\1\d{4}\1\d{4}|3[47]\d\d([ \-]?)\d{6}\2\d{5}"
          r"|3[0689]\d\d([ \-]?)\d{6}\3\d{4}|6\d{3}([ \-]?)\d{4}\4\d{4}\4\d{4}\4\d{1,3})$")
#: Digits of a country code and a national number of fixed length, with or without the trunk 0.
PLANNED = (r"^(?:1[2-9]\d\d[2-9]\d{6}|7\d{10}|(?:31|33|34|41|48|61|351|420|421)0?[1-9]\d{8}"
           r"|(?:44|91)0?[1-9]\d{9}|(?:45|47|65)\d{8}|861\d{10})$")

#: The country code in the digits of a number that fits its country's plan.
PLAN_CODE = (r"^(1(?=[2-9]\d\d[2-9]\d{6}$)|7(?=\d{10}$)|(?:31|33|34|41|48|61|351|420|421)(?=0?[1-9]\d{8}$)"
             r"|(?:44|91)(?=0?[1-9]\d{9}$)|(?:45|47|65)(?=\d{8}$)|86(?=1\d{10}$))")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once."""
    return F.transform(F.array(value), then)[0]


def _number(hex_digits: Column) -> Column:
    return F.conv(F.substring(hex_digits, 1, 15), 16, 10).cast("long")


def feistel(x: Column, y: Column, a: Column, b: Column, tweak: str, key: str) -> Column:
    """Struct (x, y) permuted within a x b."""
    def turn(s: Column, k: Column) -> Column:
        mixed = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), a.cast("string"), b.cast("string"),
                                   k.cast("string"), s["y"].cast("string")), 256)
        span = F.when(k % 2 == 1, a).otherwise(b)
        return F.struct(s["y"].alias("x"), ((s["x"] + _number(mixed) % span) % span).alias("y"))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _ten(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def _permuted_digits(digits: Column, tweak: str, key: str) -> Column:
    """Another string of as many digits (2 to 36)."""
    def of(d: Column) -> Column:
        n = F.length(d)
        h = F.floor(n / 2).cast("int")
        left, right = F.substring(d, F.lit(1), h).cast("long"), F.substring(d, h + 1, n).cast("long")
        return _let(feistel(left, right, _ten(h), _ten(n - h), tweak, key), lambda s: F.concat(
            F.lpad(s["x"].cast("string"), h, F.lit("0")), F.lpad(s["y"].cast("string"), n - h, F.lit("0"))))

    return _let(digits, of)


def _permuted_national(digits: Column, tweak: str, key: str) -> Column:
    """Another number of as many digits with as many zeros before them, the next digit from 1 to 9."""
    def of(d: Column) -> Column:
        n = F.length(d)
        h = F.floor(n / 2).cast("int")
        least = _ten(h - 1)
        left, right = F.substring(d, F.lit(1), h).cast("long") - least, F.substring(d, h + 1, n).cast("long")
        return _let(feistel(left, right, least * 9, _ten(n - h), tweak, key), lambda s: F.concat(
            (s["x"] + least).cast("string"), F.lpad(s["y"].cast("string"), n - h, F.lit("0"))))

    def past(zeros: Column) -> Column:
        rest = F.substring(digits, F.length(zeros) + 1, F.length(digits))
        return F.when(F.length(rest) >= 2, F.concat(zeros, _let(rest, of))).otherwise(digits)

    return _let(F.regexp_extract(digits, "^(0*)", 1), past)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _refilled(v: Column, digits: Column, skip: int = 0) -> Column:
    """``v`` with its digits replaced in order, the first ``skip`` characters left alone."""
    def fill(d: Column) -> Column:
        tail = F.substring(v, F.lit(skip + 1), F.length(v))
        chars = F.transform(F.sequence(F.lit(1), F.length(tail)), lambda i: F.when(
            F.substring(tail, i, F.lit(1)).rlike("[0-9]"),
            F.substring(d, F.length(_digits(F.substring(tail, F.lit(1), i))), F.lit(1)),
        ).otherwise(F.substring(tail, i, F.lit(1))))
        return F.concat(F.substring(v, 1, skip), F.array_join(chars, ""))

    return _let(digits, fill)


def _luhn(digits: Column) -> Column:
    """The sum whose last digit is 0 for a right number."""
    def add(s: Column, i: Column) -> Column:
        c = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return s + F.when(i % 2 == 1, c).otherwise(2 * c - F.when(c > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _card(v: Column, key: str) -> Column:
    """The first two digits, which name the issuer, are kept, and the check digit is made anew."""
    def made(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 2), _permuted_digits(F.substring(d, F.lit(3), F.length(d) - 3), "card", key))
        return _let(body, lambda b: F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))

    return _let(_digits(v), lambda d: F.when((_luhn(d) % 10 == 0) & (d.cast("decimal(20,0)") > 0), _refilled(v, made(d))))


def _ipv4(v: Column, key: str) -> Column:
    def made(p: Column) -> Column:
        right = F.forall(p, lambda x: (x.cast("int") <= 255) & ((x == "0") | ~x.startswith("0")))
        half = lambda i: p[i].cast("long") * 256 + p[i + 1].cast("long")
        side = F.lit(65536).cast("long")
        dots = lambda s: [F.floor(s / 256).cast("string"), (s % 256).cast("string")]
        return F.when(right, _let(feistel(half(0), half(2), side, side, "ipv4", key),
                                  lambda s: F.concat_ws(".", *dots(s["x"]), *dots(s["y"]))))

    return _let(F.split(v, r"\."), made)


def _moved_date(day: Column, key: str) -> Column:
    a, b = (F.lit(n).cast("long") for n in DATE_BLOCK)

    def made(d: Column) -> Column:
        size = DATE_BLOCK[0] * DATE_BLOCK[1]
        block = F.floor(d / size).cast("long")
        at = d - block * size
        return _let(feistel(F.floor(at / DATE_BLOCK[1]).cast("long"), at % DATE_BLOCK[1], a, b, "date", key), lambda s:
                    F.date_add(F.lit("1900-01-01").cast("date"), (block * size + s["x"] * DATE_BLOCK[1] + s["y"]).cast("int")))

    return _let(F.datediff(day, F.lit("1900-01-01").cast("date")).cast("long"), made)


def _day(year: Column, month: Column, day: Column) -> Column:
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(year >= "0300", text.try_cast("date"))


def _iso_date(v: Column, key: str) -> Column:
    p = F.split(v, "-")
    return _let(_day(p[0], p[1], p[2]), lambda d: F.when(d.isNotNull(), F.date_format(_moved_date(d, key), "yyyy-MM-dd")))


def _day_date(v: Column, key: str) -> Column:
    """Day first if that is a date, else month first; the parts keep their places."""
    mark = F.when(v.contains("/"), "/").otherwise(".")
    wide = F.length(v) == 10

    def shown(d: Column, day_first: bool) -> Column:
        both = [F.date_format(d, "dd"), F.date_format(d, "MM")]
        parts = [F.when(wide, x).otherwise(x.cast("int").cast("string")) for x in (both if day_first else both[::-1])]
        return F.concat_ws("", parts[0], mark, parts[1], mark, F.date_format(d, "yyyy"))

    def moved(p: Column, month: int, day: int) -> Column:
        return _let(_day(p[2], p[month], p[day]), lambda d: F.when(
            d.isNotNull(), _let(_moved_date(d, key), lambda new: shown(new, day == 0))))

    def made(p: Column) -> Column:
        return F.coalesce(moved(p, 1, 0), moved(p, 0, 1))

    return _let(F.split(v, "[./]"), made)


def _ssn(v: Column, key: str) -> Column:
    """Area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999."""
    p = F.split(v, "-")
    area, group, serial = (p[i].cast("long") for i in range(3))
    right = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    index = area - F.when(area > 666, 2).otherwise(1)
    moved = feistel(index, (group - 1) * 9999 + serial - 1, F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"), "ssn", key)
    pad = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
    return F.when(right, _let(moved, lambda s: F.concat_ws(
        "-", pad(s["x"] + F.when(s["x"] >= 665, 2).otherwise(1), 3), pad(F.floor(s["y"] / 9999) + 1, 2), pad(s["y"] % 9999 + 1, 4))))


def _mod97(text: Column) -> Column:
    def add(s: Column, c: Column) -> Column:
        value = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (s * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


def _iban(v: Column, key: str) -> Column:
    """Country and letters kept, digits of the account permuted, check digits made anew."""
    def turned(t: Column) -> Column:
        return F.concat(F.substring(t, F.lit(5), F.length(t)), F.substring(t, 1, 4))

    def made(t: Column) -> Column:
        account = _let(_refilled(v, _permuted_digits(_digits(F.substring(t, F.lit(5), F.length(t))), "iban", key), 4), lambda x: x)

        def checked(x: Column) -> Column:
            zero = F.concat(F.substring(x, 1, 2), F.lit("00"), F.regexp_replace(F.substring(x, F.lit(5), F.length(x)), " ", ""))
            check = F.lpad((98 - _mod97(turned(zero))).cast("string"), 2, "0")
            return F.concat(F.substring(x, 1, 2), check, F.substring(x, F.lit(5), F.length(x)))

        enough = F.length(_digits(F.substring(t, F.lit(5), F.length(t)))) >= 2
        return F.when((_mod97(turned(t)) == 1) & enough, _let(account, checked))

    return _let(F.regexp_replace(v, " ", ""), made)


def _phone(v: Column, key: str) -> Column:
    """National digits permuted within what the country's plan admits; zeros before them stay.

    North American numbers keep area and exchange from 200 up, Chinese ones their first digit.
    """
    planned = F.regexp_extract(_digits(v), PLAN_CODE, 1)
    parted = F.regexp_extract(v, r"^\+(\d{1,3}?)(?:[ .\-(]|(?<=\+1))", 1)
    code = F.when(v.startswith("+"), F.when(planned != "", planned).otherwise(parted)).otherwise("")

    def made(c: Column) -> Column:
        skip = F.length(c)

        def of(d: Column) -> Column:
            american = (F.length(d) == 10) & c.isin("", "1") & d.rlike("^[2-9]..[2-9]")
            area, rest = F.substring(d, 1, 3).cast("long") - 200, F.substring(d, 4, 7).cast("long") - 2_000_000
            moved = _let(feistel(area, rest, F.lit(800).cast("long"), F.lit(8_000_000).cast("long"), "phone", key),
                         lambda s: F.concat((s["x"] + 200).cast("string"), (s["y"] + 2_000_000).cast("string")))
            chinese = (c == "86") & d.rlike(r"^1\d{10}$")
            new = F.when(american, moved).when(chinese, F.concat(F.lit("1"), _permuted_digits(F.substring(d, 2, 10), "phone", key)))
            new = new.otherwise(_permuted_national(d, "phone", key))
            return F.when(F.length(d).between(6, 15), _refilled(v, F.concat(c, new)))

        return _let(F.substring(_digits(v), skip + 1, F.length(v)), of)

    return _let(code, made)


def _digest(v: Column, key: str, n: int) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("digest"), v), 256), 1, n)


def _mail(v: Column, key: str) -> Column:
    return F.concat(F.lit("u"), _digest(F.lower(v), key, 16), F.lit("@example.invalid"))


def _secret(v: Column, key: str) -> Column:
    head = F.regexp_extract(v, r"^([\w.\-]+\s*[=:]\s*[\"']?)", 1)
    return _let(head, lambda h: F.concat(h, F.lit("secret_"), _digest(F.substring(v, F.length(h) + 1, F.length(v)), key, 16)))


def _made(kind: Column, v: Column, key: str) -> Column:
    """The pseudonym of a candidate, null if it is not a valid value."""
    makers = {
        "mail": _mail, "cloud_key": lambda v, k: F.concat(F.lit("secret_"), _digest(v, k, 16)), "secret": _secret,
        "iso_date": _iso_date, "ipv4": _ipv4, "day_date": _day_date, "ssn": _ssn, "card": _card, "odd_card": _card,
        "iban": _iban, "phone": _phone}
    new = F.lit(None).cast("string")
    for name, maker in makers.items():
        new = F.when(kind == name, maker(v, key)).otherwise(new)
    return new


def _candidates(w: Column, rest: Column) -> Column:
    """What may start at the start of ``w``, in the order of trial. ``rest`` is ``w`` up to the end of the text."""
    def at(form: str, text: Column = w) -> Column:
        return F.regexp_extract(text, f"^(?:{form})", 0)

    def long(form: str) -> Column:
        return _let(at(form), lambda v: F.when(F.length(v) < F.length(w), v).otherwise(at(form, rest)))

    def some(kind: str, v: Column, when: Callable[[Column], Column] | None = None) -> Column:
        v = v if when is None else _let(v, lambda x: F.when(when(x), x).otherwise(""))
        return F.struct(F.lit(kind).alias("kind"), v.alias("v"))

    phones, cards = [at(x) for x in PHONES], [at(x) for x in CARDS]
    each = [some(k, long(FORMS[k])) for k in ("mail", "secret")]
    each += [some(k, at(FORMS[k])) for k in ("cloud_key", "iso_date", "ipv4", "day_date", "ssn")]
    each += [some("iban", at(x)) for x in IBANS]
    each += [some("phone", x, lambda v: _digits(v).rlike(PLANNED)) for x in phones]
    each += [some("phone", x) for x in [*phones, at(PHONE_LOCAL)]]
    each += [some("card", x, lambda v: v.rlike(ISSUED)) for x in cards]
    each += [some("odd_card", x, lambda v: ~v.rlike(f"^(?:{ISO_DATE}|{SSN})")) for x in cards]
    return F.filter(F.array(*each), lambda c: c["v"] != "")


def _values(key: str) -> Column:
    """The valid values of ``pieces``, which start at the places: piece, piece after it, kind, pseudonym, text up to there."""
    pieces = F.col("pieces")

    def value(piece: Column, i: Column) -> Column:
        w = F.array_join(F.slice(pieces, i + 1, WINDOW), "")
        rest = F.array_join(F.slice(pieces, i + 1, F.size(pieces)), "")

        def first(w: Column) -> Column:
            tried = F.transform(_candidates(w, rest), lambda c: F.struct(
                c["kind"].alias("kind"), c["v"].alias("v"), _made(c["kind"], c["v"], key).alias("new")))
            return F.get(F.filter(tried, lambda c: c["new"].isNotNull()), F.lit(0))

        def placed(c: Column) -> Column:
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars"))
            end = F.aggregate(F.slice(pieces, i + 1, F.least(F.length(c["v"]), F.size(pieces))), start, lambda a, p: F.when(
                a["chars"] < F.length(c["v"]),
                F.struct((a["n"] + 1).alias("n"), (a["chars"] + F.length(p)).alias("chars"))).otherwise(a))
            return _let(end, lambda e: F.struct(
                i.alias("i"), (i + e["n"]).alias("next"), c["kind"].alias("kind"), c["new"].alias("pseudonym"),
                F.substring(F.array_join(F.slice(pieces, i + 1, e["n"]), ""), F.length(c["v"]) + 1, e["chars"]).alias("tail")))

        return _let(_let(w, first), lambda c: F.when(c.isNotNull(), placed(c)))

    return F.filter(F.transform(pieces, value), lambda x: x.isNotNull())


def _apart() -> Column:
    """``values`` without overlaps: the first from the left, but an odd card gives way to what starts in it."""
    values = F.col("values")
    sure = F.filter(values, lambda x, k: (x["kind"] != "odd_card") | ~F.exists(
        F.slice(values, k + 2, WINDOW), lambda y: (y["kind"] != "odd_card") & (y["i"] < x["next"])))
    none = F.filter(values, lambda x: F.lit(False))
    return F.aggregate(sure, none, lambda a, x: F.when(
        (F.size(a) == 0) | (F.get(a, F.size(a) - 1)["next"] <= x["i"]), F.concat(a, F.array(x))).otherwise(a))


def pseudonymised(df: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """Each row as ``row``, its new text as ``out.text``, and ``out.found``: kinds and pseudonyms in order."""
    key = key if key is not None else df.sparkSession.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"set {KEY_SETTING}, or pass a key: who knows it can undo the pseudonyms")
    rows = packed(df, text=text)
    # A digit, @, =, : or the start of a cloud key is in every form; texts without them are not searched.
    some = F.col("text").rlike("[0-9@=:]|AKIA|ASIA") & F.col("text").rlike(PLACE)
    rows = rows.withColumn("pieces", F.when(some, F.split("text", PLACE, -1)).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("values", _values(key))
    rows = rows.withColumn("taken", _apart())
    pieces, taken = F.col("pieces"), F.col("taken")

    def filled(x: Column, k: Column) -> Column:
        before = F.when(k > 0, F.get(taken, k - 1)["next"]).otherwise(0)
        return F.concat(F.array_join(F.slice(pieces, before + 1, x["i"] - before), ""), x["pseudonym"], x["tail"])

    end = F.get(taken, F.size(taken) - 1)["next"]
    joined = F.concat(F.array_join(F.transform(taken, filled), ""), F.array_join(F.slice(pieces, end + 1, F.size(pieces)), ""))
    found = F.transform(taken, lambda x: F.struct(
        F.when(x["kind"] == "odd_card", "card").otherwise(x["kind"]).alias("kind"), x["pseudonym"].alias("pseudonym")))
    return once(rows, "out", text=F.when(F.size("taken") > 0, joined).otherwise(F.col("text")), found=found).select("row", "out")


def replace_personal(df: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """All rows and columns, with ``text`` made pseudonymous."""
    out = pseudonymised(df, text, key)
    return out.select(*(F.col("out.text" if c == text else f"row.`{c}`").alias(c) for c in df.columns))


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text", key: str | None = None) -> DataFrame:
    """The new text of every document and what was replaced in it."""
    out = pseudonymised(df.select(doc_id, text), text, key)
    return out.select(F.col(f"row.`{doc_id}`").alias("doc_id"), F.col("out.text").alias("text"),
                      F.size("out.found").cast("long").alias("n_found"), F.col("out.found").alias("found"))
