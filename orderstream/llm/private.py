"""Pseudonyms for personal data that keep the data's format.

One pattern finds candidates; each is validated (checksum, calendar, ranges) and then permuted by a keyed Feistel network
over the values of its own format: card numbers keep their length and checksum, dates stay dates between 1900 and 2099
written the same way, social-security numbers and addresses stay valid ones, telephone numbers keep their punctuation.
A run of digit groups is searched for cards: first groups that are a valid card alone, then, from the left, the longest
valid sequence of whole groups; so an expiry date or a code beside a card does not hide it.
A permutation never maps two values to one, and the same value has the same pseudonym in every document. Mail addresses
and secrets, which are no numbers, get keyed digests in their own shape. Numbers that fail validation stay.

Everything is built-in functions over the row's own text; nothing is shuffled. Null text stays null, empty text empty.
Repeated rows are treated alike. An empty table gives an empty table. Other columns pass through untouched; the counts
go to one struct column whose name the caller picks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderstream.llm.common import read, spare

KEY = "pseudonym-key"
ROUNDS = 8

# The shapes of what is looked for, tried in this order.
SHAPES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)",
    "phone": "|".join(
        [
            r"\+\d{1,3}[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)",
            r"\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
            r"\+\d{1,3}(?:[ .-]\d{2,3}){4}(?!\d)",
            r"\+\d{1,3}[ .-]\d(?:[ .-]\d{2}){4}(?!\d)",
            r"\+\d{1,3}(?:[ .-]\d{2,4}){2,3}(?!\d)",
            r"\+\d{1,3}[ .-]\d{1,5}[ .-]\d{4,8}(?!\d)",
            r"\+\d{8,15}(?!\d)",
            r"(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)",
            r"(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])",
            r"(?<![\d.])\d{3}\.\d{3}\.\d{4}(?!\.?\d)",
            r"(?<![\d-])\d{3} \d{3} \d{4}(?![ -]?\d)",
        ]
    ),
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "date": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d.])\d{2}\.\d{2}\.\d{4}(?!\.?\d)|(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])",
    "card": "",
    "secret": r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]{0,63}\d)(?=[0-9A-Fa-f]{0,63}[A-Fa-f])[0-9A-Fa-f]{24,64}(?![0-9A-Za-z])",
}
# A run of digit groups, as far as no other shape begins.
OTHERS = "|".join(x for x in SHAPES.values() if x)
SHAPES["card"] = rf"(?<!\d)(?<!\d\.)\d(?:(?:[ -](?!{OTHERS}))?\d){{12,}}+"
ANY = "|".join(SHAPES.values())
WHOLE = SHAPES | {"card": r"\d(?:[ -]?\d){12,}+"}


def digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def keyed(key: str, *parts: Column) -> Column:
    """60 bits of a keyed digest."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def feistel(value: Column, a: Column | int, b: Column | int, kind: str, key: str) -> Column:
    """A keyed permutation of 0 .. a*b - 1: halves modulo a and b take turns in being shifted by the other's digest."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))

    def turn(s: Column, i: Column) -> Column:
        left = F.pmod(s["l"] + F.pmod(keyed(key, F.lit(kind), i, s["r"]), a), a)
        right = F.pmod(s["r"] + F.pmod(keyed(key, F.lit(kind), i, s["l"]), b), b)
        odd = i % 2 == 1
        return F.struct(F.when(odd, left).otherwise(s["l"]).alias("l"), F.when(odd, s["r"]).otherwise(right).alias("r"))

    start = F.struct(quotient(value, b).alias("l"), F.pmod(value, b).alias("r"))
    return F.aggregate(F.array(*[F.lit(i) for i in range(1, ROUNDS + 1)]), start, turn, lambda s: s["l"] * b + s["r"])


def quotient(x: Column, y: Column) -> Column:
    """Whole-number division of longs."""
    return F.call_function("div", x, y)


def permuted_digits(x: Column, kind: str, key: str) -> Column:
    """A string of 1 to 18 digits, permuted among those of its length."""
    n = F.length(x)
    low = F.floor(n / 2).cast("int")
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    return F.lpad(feistel(x.cast("long"), power(n - low), power(low), kind, key).cast("string"), n, "0")


def refilled(shape: Column, new: Column) -> Column:
    """The shape with its digits replaced, in order, by new ones."""
    return F.aggregate(
        F.split(shape, ""),
        F.struct(F.lit("").alias("t"), F.lit(1).alias("i")),
        lambda s, c: F.when(c.rlike(r"^\d$"), F.struct(F.concat(s["t"], F.substring(new, s["i"], F.lit(1))).alias("t"), (s["i"] + 1).alias("i")))
        .otherwise(F.struct(F.concat(s["t"], c).alias("t"), s["i"].alias("i"))),
        lambda s: s["t"],
    )


def luhn(x: Column) -> Column:
    """The checksum of a digit string whose last digit counts once: 0 for a valid card number."""
    d = F.split(F.reverse(x), "")
    weighed = F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(weighed, F.lit(0), lambda s, v: s + v) % 10


def valid_card(d: Column) -> Column:
    return F.when(F.length(d).between(13, 19), luhn(d) == 0).otherwise(False)


def card(x: Column, key: str) -> Column:
    """A valid card number as another."""
    d = digits(x)
    payload = permuted_digits(F.substring(d, F.lit(1), F.length(d) - 1), "card", key)
    check = F.pmod(10 - luhn(F.concat(payload, F.lit("0"))), F.lit(10))
    return refilled(x, F.concat(payload, check.cast("string")))


def bound(value: Column, body) -> Column:
    """The body over a value that is worked out once; inside other lambdas a plain expression is worked out each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def card_parts(x: Column) -> Column:
    """A run of digit groups as parts, each a card (kind card) or a group of none; separators stay with what follows."""

    def of_groups(groups: Column) -> Column:
        return bound(F.transform(groups, lambda g: valid_card(digits(g))), lambda alone: parted(groups, alone))

    return bound(F.regexp_extract_all(x, F.lit(r"[ -]?\d+"), F.lit(0)), of_groups)


def parted(groups: Column, alone: Column) -> Column:
    """The parts of a run by its groups and by which of them are cards alone."""

    def length(i: Column) -> Column:
        """How many groups the card that begins at the i-th has."""
        rest = F.least(F.size(groups) - i, F.lit(19))
        ends = F.filter(
            F.sequence(rest, F.lit(1), F.lit(-1)),
            lambda k: ~F.exists(F.slice(alone, i + 1, k), lambda c: c) & valid_card(digits(F.array_join(F.slice(groups, i + 1, k), ""))),
        )
        return F.when(F.get(alone, i), 1).otherwise(F.coalesce(F.get(ends, F.lit(0)), F.lit(0)))

    part = "struct<x:string,kind:string>"
    start = F.struct(F.lit(0).alias("next"), F.array().cast(f"array<{part}>").alias("parts"))

    def step(s: Column, i: Column) -> Column:
        def taken(n: Column) -> Column:
            size = F.greatest(n, F.lit(1))
            new = F.array(F.struct(F.array_join(F.slice(groups, i + 1, size), "").alias("x"), F.when(n > 0, F.lit("card")).alias("kind")))
            return F.struct((i + size).alias("next"), F.concat(s["parts"], new).alias("parts"))

        return F.when(i < s["next"], s).otherwise(bound(length(i), taken))

    return F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1), start, step, lambda s: s["parts"])


def ip(x: Column, key: str) -> Column:
    parts = F.transform(F.split(x, r"\."), lambda p: p.cast("long"))
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s * 256 + p)
    new = feistel(value, 65536, 65536, "ip", key)
    octet = lambda i: F.pmod(F.shiftright(new, 24 - 8 * i), F.lit(256)).cast("string")
    return F.when(F.forall(parts, lambda p: p <= 255), F.concat_ws(".", *[octet(i) for i in range(4)]))


def ssn(x: Column, key: str) -> Column:
    """Areas 001-899 without 666, groups 01-99, serials 0001-9999."""
    area, group, serial = (F.substring(x, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = ((area - 1 - (area > 666).cast("long")) * 99 + group - 1) * 9999 + serial - 1
    new = feistel(place, 898 * 99, 9999, "ssn", key)
    head = quotient(new, F.lit(9999))
    a = quotient(head, F.lit(99)) + 1
    a = a + (a >= 666).cast("long")
    text = lambda v, n: F.lpad(v.cast("long").cast("string"), n, "0")
    return F.when(valid, F.concat_ws("-", text(a, 3), text(F.pmod(head, F.lit(99)) + 1, 2), text(F.pmod(new, F.lit(9999)) + 1, 4)))


FIRST_DAY, DAYS = "1900-01-01", (17, 4297)  # 73,049 days to the end of 2099


def date(x: Column, key: str) -> Column:
    """Slashes: month first where that is a date, else day first; each order is permuted among its own dates."""
    parsed = lambda f: F.try_to_timestamp(x, F.lit(f)).cast("date")

    def shifted(day: Column, form: str, kind: str) -> Column:
        n = F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
        new = F.date_add(F.lit(FIRST_DAY).cast("date"), feistel(n, *DAYS, kind, key).cast("int"))
        return F.when((n >= 0) & (n < DAYS[0] * DAYS[1]), F.date_format(new, form))

    def day_first(day: Column) -> Column:
        # Days after the twelfth of a year: year and place among them, so the result cannot be read month first.
        year, place = F.year(day) - 1900, (F.month(day) - 1) * 16 + F.dayofmonth(day) - 13
        new = feistel((year * 192 + place).cast("long"), 200, 192, "day-first", key)
        y, p = quotient(new, F.lit(192)), F.pmod(new, F.lit(192))
        m, d = quotient(p, F.lit(16)) + 1, F.pmod(p, F.lit(16)) + 13
        text = lambda v, n: F.lpad(v.cast("long").cast("string"), n, "0")
        return F.when((year >= 0) & (year < 200) & (F.dayofmonth(day) <= 28), F.concat_ws("/", text(d, 2), text(m, 2), text(y + 1900, 4)))

    return (
        F.when(F.substring(x, 5, 1) == "-", shifted(parsed("yyyy-MM-dd"), "yyyy-MM-dd", "date"))
        .when(F.substring(x, 3, 1) == ".", shifted(parsed("dd.MM.yyyy"), "dd.MM.yyyy", "date"))
        .when(parsed("MM/dd/yyyy").isNotNull(), shifted(parsed("MM/dd/yyyy"), "MM/dd/yyyy", "date"))
        .otherwise(day_first(parsed("dd/MM/yyyy")))
    )


def email(x: Column, key: str) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{key}|email|"), F.lower(x)).cast("binary"), 256)
    domain = F.sha2(F.concat(F.lit(f"{key}|domain|"), F.lower(F.substring_index(x, "@", -1))).cast("binary"), 256)
    return F.concat(F.lit("u"), F.substring(digest, 1, 24), F.lit("@d"), F.substring(domain, 1, 24), F.lit("."), F.substring_index(x, ".", -1))


def secret(x: Column, key: str) -> Column:
    digest = F.substring(F.sha2(F.concat(F.lit(f"{key}|secret|"), x).cast("binary"), 256), F.lit(1), F.length(x))
    return F.when(x.rlike("[A-F]"), F.upper(digest)).otherwise(digest)


def phone(x: Column, key: str) -> Column:
    """A country code that is set off stays, all other digits change; without one the last ten do. 8 to 15 digits."""
    d = digits(x)
    code = F.length(F.regexp_extract(x, r"^\+(\d{1,3})[ .(-]", 1))
    cut = F.when(code > 0, code).otherwise(F.greatest(F.length(d) - 10, F.lit(0)))
    new = F.concat(F.substring(d, F.lit(1), cut), permuted_digits(F.substring(d, cut + 1, F.length(d)), "phone", key))
    return F.when(F.length(d).between(8, 15), refilled(x, new))


KINDS = {"email": email, "ip": ip, "phone": phone, "ssn": ssn, "date": date, "card": card, "secret": secret}


def named(x: Column) -> Column:
    """The first kind whose shape the whole candidate has."""
    out = F.lit(None).cast("string")
    for name in reversed(SHAPES):
        out = F.when(x.rlike(rf"^(?:{WHOLE[name]})$"), F.lit(name)).otherwise(out)
    return out


def pseudonym(found: Column, key: str) -> Column:
    out = F.lit(None).cast("string")
    for name, rule in KINDS.items():
        out = F.when(found["kind"] == name, rule(found["x"], key)).otherwise(out)
    return out


def replaced(kind: str):
    return lambda f: (f["kind"] == kind) & f["y"].isNotNull()


def pseudonymized(docs: DataFrame, key: str = KEY, text_col: str = "text", counts: str = "private") -> DataFrame:
    """The documents with private values replaced, and a struct of how many of each kind were."""
    text = F.col(text_col)
    empty = F.array().cast("array<struct<x:string,kind:string>>")
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(0)), lambda x: F.struct(x.alias("x"), named(x).alias("kind")))
    # Columns of the documents' own may have any names.
    found_, parts_, pieces_, between_, new_ = (spare(n, docs.columns) for n in ("_found", "_parts", "_pieces", "_between", "_new"))
    out = docs.withColumn(found_, F.when(text.rlike(ANY), found).otherwise(empty))
    whole = lambda f: F.array(F.struct(f["x"].alias("x"), f["kind"].alias("kind")))
    parts = F.transform(found_, lambda f: F.when(f["kind"] == "card", card_parts(f["x"])).otherwise(whole(f)))
    out = out.withColumn(parts_, parts)
    pseudonyms = lambda p: F.transform(p, lambda f: F.struct(f["kind"].alias("kind"), f["x"].alias("x"), pseudonym(f, key).alias("y")))
    out = out.withColumn(pieces_, F.transform(parts_, pseudonyms)).withColumn(new_, F.flatten(pieces_))
    joined = lambda p: F.array_join(F.transform(p, lambda f: F.coalesce(f["y"], f["x"])), "")
    between = F.split(text, ANY)
    out = out.withColumn(between_, F.when(F.size(found_) > 0, between))
    woven = F.concat(
        F.get(between_, F.lit(0)),
        F.array_join(F.transform(pieces_, lambda p, i: F.concat(joined(p), F.get(between_, i + 1))), ""),
    )
    number = [F.size(F.filter(new_, replaced(k))).cast("long").alias(k) for k in KINDS]
    return out.select(
        *[F.when(F.size(found_) > 0, woven).otherwise(text).alias(text_col) if c == text_col else F.col(c) for c in docs.columns],
        F.struct(*number).alias(counts),
    )


def query(spark, folder: str) -> DataFrame:
    out = pseudonymized(read(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", *[F.col("private")[k].alias(f"n_{k}") for k in KINDS])
