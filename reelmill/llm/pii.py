"""Personal data to pseudonyms of the same format, by keyed Feistel permutations.

Validated card numbers, phone numbers, addresses of machines, social security
numbers, bank accounts and dates are permuted within their format; equal values get
equal pseudonyms in all documents, and different values different ones. Everything
is an expression over the text column: texts are split at what looks like personal
data, each piece is validated and permuted, and the pieces are put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The shapes of personal data (kind, pattern), in the order in which they are tried at a place.
SHAPES = (
    ("email", r"(?<![\p{L}\p{N}_.%+-])[\p{L}\p{N}_.%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("account", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("date", r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/-])"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("address", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"),
    ("phone", r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)"),
    ("card", r"(?<![\dA-Za-z.])(?:\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\dA-Za-z])"),
)
KINDS = tuple(k for k, _ in SHAPES)
_ANY = "|".join(f"({p})" for _, p in SHAPES)
#: What divides days into a 400-year cycle of the calendar, 146,097 = 189 * 773.
CYCLE, HIGH, LOW = 146_097, 189, 773
ROUNDS = 8


def _mixed(key: str, what: str, turn: Column, half: Column) -> Column:
    """A keyed 60-bit number of a round and a half."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(what), turn, half), 256), 1, 15), 16, 10).cast("long")


def feistel(value_high: Column, value_low: Column, high: Column, low: Column, key: str, what: str) -> Column:
    """The struct (a, b) that a keyed permutation of the pairs (a < high, b < low) makes of a pair.

    Even rounds shift a by a keyed number of b, odd ones b by one of a; each can be
    undone, so that different pairs stay different.
    """
    start = F.struct(value_high.cast("long").alias("a"), value_low.cast("long").alias("b"))
    even = lambda s, r: (s["a"] + F.pmod(_mixed(key, what, r, s["b"]), high)) % high
    odd = lambda s, r: (s["b"] + F.pmod(_mixed(key, what, r, s["a"]), low)) % low
    step = lambda s, r: F.struct(F.when(r % 2 == 0, even(s, r)).otherwise(s["a"]).alias("a"), F.when(r % 2 == 1, odd(s, r)).otherwise(s["b"]).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permuted_digits(digits: Column, key: str, what: str) -> Column:
    """A string of 2 to 36 digits, permuted among the strings of its length."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    high, low = F.pow(F.lit(10.0), left).cast("long"), F.pow(F.lit(10.0), n - left).cast("long")
    a, b = F.left(digits, left).cast("long"), F.right(digits, n - left).cast("long")
    made = feistel(a, b, high, low, key, what)
    return F.concat(F.lpad(made["a"].cast("string"), left, F.lit("0")), F.lpad(made["b"].cast("string"), n - left, F.lit("0")))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, its check digit included."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 1, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)).otherwise(d.cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def refilled(shape: Column, digits: Column) -> Column:
    """shape with its digits, one after another, replaced by those of digits."""
    step = lambda s, c: F.when(
        c.rlike("^[0-9]$"), F.struct(F.concat(s["out"], F.substr(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))
    ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))
    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda s: s["out"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _card(x: Column, key: str) -> Column:
    """13 to 19 digits with a right check digit: all but it are permuted, and it is made right again."""
    digits = _digits(x)
    body = permuted_digits(F.left(digits, F.length(digits) - 1), key, "card")
    check = F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    return F.when(luhn_sum(digits) % 10 == 0, refilled(x, F.concat(body, check)))


def _phone(x: Column, key: str) -> Column:
    """8 to 15 digits: the country stays, the rest is permuted."""
    digits, country = _digits(x), F.regexp_extract(x, r"^\+(\d{1,3})[ .(-]", 1)
    kept = F.length(country)
    return F.when((F.length(digits) >= 8) & (F.length(digits) <= 15), refilled(x, F.concat(country, permuted_digits(F.right(digits, F.length(digits) - kept), key, "phone"))))


def _address(x: Column, key: str) -> Column:
    """Four numbers up to 255, permuted as one of 2**32 values, written without leading zeros."""
    parts = F.transform(F.split(x, r"\."), lambda p: p.cast("int"))
    fine = F.forall(parts, lambda p: p <= 255)
    made = feistel(parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], F.lit(65536), F.lit(65536), key, "address")
    numbers = F.array((made["a"] / 256).cast("int"), (made["a"] % 256).cast("int"), (made["b"] / 256).cast("int"), (made["b"] % 256).cast("int"))
    return F.when(fine, F.array_join(F.transform(numbers, lambda p: p.cast("string")), "."))


def _ssn(x: Column, key: str) -> Column:
    """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999, permuted among such numbers."""
    area, group, serial = F.substring(x, 1, 3).cast("int"), F.substring(x, 5, 2).cast("int"), F.substring(x, 8, 4).cast("int")
    fine = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    dense = area - 1 - F.when(area > 666, 1).otherwise(0)
    made = feistel(dense, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")
    new_area = made["a"] + 1 + F.when(made["a"] >= 665, 1).otherwise(0)
    pad = lambda n, k: F.lpad(n.cast("int").cast("string"), k, "0")
    return F.when(fine, F.concat_ws("-", pad(new_area, 3), pad(F.floor(made["b"] / 9999) + 1, 2), pad(made["b"] % 9999 + 1, 4)))


def _date(x: Column, key: str) -> Column:
    """A date of the calendar, permuted within its cycle of 400 years from 1700, 2100 and so on.

    Day before month goes for dates with points, month before day for those with
    strokes. 189 * 773 days make a cycle, and so no other day can come out.
    """
    form = F.when(x.contains("-"), F.lit("yyyy-MM-dd")).when(x.contains("/"), F.lit("MM/dd/yyyy")).otherwise(F.lit("dd.MM.yyyy"))
    day = F.when(x.contains("-"), x).when(x.contains("/"), F.concat_ws("-", F.right(x, F.lit(4)), F.left(x, F.lit(2)), F.substring(x, 4, 2)))
    day = day.otherwise(F.concat_ws("-", F.right(x, F.lit(4)), F.substring(x, 4, 2), F.left(x, F.lit(2)))).try_cast("date")
    start = F.lit("1700-01-01").cast("date")
    since = F.datediff(day, start)
    cycle, within = F.floor(since / CYCLE), F.pmod(since, F.lit(CYCLE))
    made = feistel(F.floor(within / LOW), within % LOW, F.lit(HIGH), F.lit(LOW), key, "date")
    new = F.date_add(start, (cycle * CYCLE + made["a"] * LOW + made["b"]).cast("int"))
    return F.when(day.isNotNull() & (F.year(day) >= 100) & (F.year(day) < 9700), F.when(form == "yyyy-MM-dd", F.date_format(new, "yyyy-MM-dd")).when(form == "MM/dd/yyyy", F.date_format(new, "MM/dd/yyyy")).otherwise(F.date_format(new, "dd.MM.yyyy")))


def _mod97(x: Column) -> Column:
    """A bank account's remainder: the first four characters go last, and letters count from 10."""
    turned = F.concat(F.substr(x, F.lit(5)), F.left(x, F.lit(4)))
    number = F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[0-9]"), c.cast("string")).otherwise((F.ascii(c) - 55).cast("string")))
    return F.aggregate(F.split(F.array_join(number, ""), ""), F.lit(0), lambda s, d: (s * 10 + d.cast("int")) % 97)


def _account(x: Column, key: str) -> Column:
    """A bank account with right check digits: the digits after them are permuted, and they are made right again."""
    plain = F.replace(x, F.lit(" "), F.lit(""))
    body = F.substr(plain, F.lit(5))
    digits = _digits(body)
    fine = (F.length(digits) >= 4) & (F.length(plain) >= 12)
    short = F.when(F.length(digits) <= 36, digits)
    new = refilled(body, permuted_digits(short, key, "account"))
    check = F.lpad((98 - _mod97(F.concat(F.left(plain, F.lit(2)), F.lit("00"), new))).cast("string"), 2, "0")
    return F.when(fine & (_mod97(plain) == 1), refilled(x, _digits(F.concat(check, new))))


def _email(x: Column, key: str) -> Column:
    """A mailbox has no numbering to permute: it becomes a keyed name of 16 letters and digits at a reserved domain."""
    return F.concat(F.lit("user-"), F.left(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("email"), F.lower(x)), 256), F.lit(16)), F.lit("@example.invalid"))


_MAKE = {"email": _email, "account": _account, "date": _date, "ssn": _ssn, "address": _address, "phone": _phone, "card": _card}


def pseudonym(x: Column, key: str) -> Column:
    """(kind, value) of a piece that fits a shape; null if it isn't valid."""
    made = F.lit(None).cast("struct<kind:string,value:string>")
    for kind, pattern in reversed(SHAPES):
        # look-around was settled in the text; within the piece, a shape must take all of it
        new = _MAKE[kind](x, key)
        made = F.when(x.rlike(f"^(?:{pattern})$"), F.when(new.isNotNull(), F.struct(F.lit(kind).alias("kind"), new.alias("value")))).otherwise(made)
    return made


def pseudonymised(df: DataFrame, key: str, text_col: str = "text", out_col: str = "text", found_col: str = "found") -> DataFrame:
    """df with out_col, the text with pseudonyms, and found_col, an array of the kinds replaced, in order.

    Only what passes its kind's validation is replaced; all other text stays as it is,
    to the last character. A null text stays null with no kinds, an empty one empty.
    Repeated rows and values get the same pseudonyms; no row moves to another task.
    """
    text = F.col(text_col)
    pieces = F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))
    made = F.transform(pieces, lambda x: F.struct(x.alias("old"), pseudonym(x, key).alias("new")))
    whole = df.withColumn("__made", F.when(text.rlike(_ANY), made))
    gaps = F.split(text, _ANY, -1)
    joined = F.concat(
        F.array_join(F.zip_with(F.slice(gaps, 1, F.size("__made")), F.col("__made"), lambda g, m: F.concat(g, F.coalesce(m["new"]["value"], m["old"]))), ""),
        F.element_at(gaps, -1),
    )
    kinds = F.transform(F.filter("__made", lambda m: m["new"].isNotNull()), lambda m: m["new"]["kind"])
    return whole.withColumns({
        found_col: F.coalesce(kinds, F.array().cast("array<string>")),
        out_col: F.when(F.col("__made").isNull(), text).otherwise(joined),
    }).drop("__made")
