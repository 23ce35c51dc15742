"""Format-preserving pseudonyms for personal numbers, dates and mail addresses (operator 6).

Found and validated with DataFrame functions only: payment card numbers (Luhn), social security numbers,
telephone numbers, IPv4 addresses, dates of the years 1600 to 2399 that exist, and mail addresses. Each
valid value is replaced by another valid value of the same format, through a keyed Feistel network over
that format, so equal values have equal pseudonyms in all documents and the holder of the key can
invert them.

* Digits and letters: two halves of the string; in turn each is shifted, digit by digit within 0-9 and
  letter by letter within a-z or A-Z, by a keyed hash of the other. Cards: all digits but the last,
  which is then the Luhn digit anew. Telephone numbers keep their country code, mail addresses their
  domain; signs stay in place.
* Social security numbers: the number's place among the 898 x 99 x 9999 valid ones, as two digits of the
  bases 898 x 99 and 9999.
* IPv4 addresses: two halves of 16 bits.
* Dates: the day's number in its 400 years (146,097 = 189 x 773 days in the calendar) as two digits
  of these bases.

A run of digits, single or repeated blanks and hyphens may hold several values, or a value beside other
numbers. It is read from left to right: at each group of digits the longest valid value that starts
there is taken (date, social security number, card, telephone number, in this order), else the group
stays and the next one is tried. A card may start and end at any group of digits.

Defined results: a null text stays null; empty texts and texts without valid values stay as they are,
as do numbers that fail validation; repeated rows repeat; other columns are kept, and ``text`` and
``pseudonyms`` are replaced where they clash; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
AREAS = 898
KINDS = ("card", "date", "ip", "mail", "phone", "ssn")

_NUMBER = r"(?<![A-Za-z0-9_])(?<![0-9][.-])"
_END = r"(?![A-Za-z0-9_])(?![.-][0-9])"
MAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
DATE = r"[0-9]{4}([-/.])[0-9]{2}\2[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\3[0-9]{4}"
IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}"
#: Digits with blanks and hyphens, read by ``_pieces``. One class of signs: a loop over groups would recurse in Java.
RUN = r"[0-9][0-9 -]{11,}(?<=[0-9])"
#: Group 1 is the whole value or run.
PATTERN = f"((?<![A-Za-z0-9._%+-]){MAIL}|{_NUMBER}(?:{DATE}|{IP}|{SSN}|{RUN}|{PHONE}){_END})"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digest(key: str, kind: str, step: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), half), 256)


def _number(digest: Column) -> Column:
    """60 bits of a digest."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _letters(text: Column, each) -> Column:
    """``each(letter, place from 1)`` of every letter, joined."""
    return F.when(F.length(text) == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda j: each(F.substr(text, j, F.lit(1)), j)), ""))


def _shift(half: Column, digest: Column, sign: int) -> Column:
    def each(c: Column, j: Column) -> Column:
        k = F.lit(sign) * F.conv(F.substr(digest, F.pmod(j - 1, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        code = F.ascii(c)
        turn = lambda base, n: F.char((F.pmod(code - base + k, F.lit(n)) + base).cast("long"))
        return F.when(c.rlike("^[0-9]$"), turn(48, 10)).when(c.rlike("^[a-z]$"), turn(97, 26)).when(c.rlike("^[A-Z]$"), turn(65, 26)).otherwise(c)

    return _letters(half, each)


def _turn(half: Column, digest: Column, sign: int) -> Column:
    return _let(digest, lambda d: _shift(half, d, sign))


def _network(start: Column, key: str, kind: str, left, right, inverse: bool) -> Column:
    """Rounds over struct(l, r): odd ones change r by a digest of l, even ones l by a digest of r."""
    steps = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))

    def step(acc: Column, i: Column) -> Column:
        odd = F.struct(acc["l"].alias("l"), right(acc["r"], _digest(key, kind, i, acc["l"].cast("string"))).alias("r"))
        even = F.struct(left(acc["l"], _digest(key, kind, i, acc["r"].cast("string"))).alias("l"), acc["r"].alias("r"))
        return F.when(i % 2 == 1, odd).otherwise(even)

    return F.aggregate(steps, start, step)


def permute_text(x: Column, key: str, kind: str, inverse: bool = False) -> Column:
    """Digits and letters permuted within their kinds."""
    half = F.floor(F.length(x) / 2).cast("int")
    start = F.struct(F.substr(x, F.lit(1), half).alias("l"), F.substr(x, half + 1).alias("r"))
    turn = lambda h, digest: _turn(h, digest, -1 if inverse else 1)
    return _let(_network(start, key, kind, turn, turn, inverse), lambda done: F.concat(done["l"], done["r"]))


def permute_number(x: Column, a: int, b: int, key: str, kind: str, inverse: bool = False) -> Column:
    """A number below a * b permuted among these."""
    sign = -1 if inverse else 1
    start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
    turn = lambda n: lambda h, digest: F.pmod(h + sign * F.pmod(_number(digest), F.lit(n)), F.lit(n)).cast("long")
    return _let(_network(start, key, kind, turn(a), turn(b), inverse), lambda done: done["l"] * b + done["r"])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits that the check digit is to follow."""
    n = F.length(digits)

    def add(total: Column, k: Column) -> Column:
        d = F.substr(digits, k, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when((n - k) % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add)


def _check_digit(digits: Column) -> Column:
    return F.pmod(10 - _luhn_sum(digits) % 10, F.lit(10)).cast("string")


def _into(format_: Column, digits: Column) -> Column:
    """The digits in the places that ``format_`` has for digits."""
    return _let(digits, lambda found: _fill(format_, found))


def _fill(format_: Column, digits: Column) -> Column:
    return _letters(format_, lambda c, j: F.when(c.rlike("^[0-9]$"), F.substr(digits, F.length(_digits(F.substr(format_, F.lit(1), j))), F.lit(1))).otherwise(c))


def _day(x: Column) -> Column:
    """The day of a date in either order of its parts; null if there is none such."""
    plain = F.regexp_replace(x, "[/.]", "-")
    iso = F.when(plain.rlike("^[0-9]{4}-"), plain).otherwise(F.concat_ws("-", F.substring(plain, 7, 4), F.substring(plain, 4, 2), F.substring(plain, 1, 2)))
    return F.when(iso.rlike("^(1[6-9]|2[0-3])[0-9]{2}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$"), F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"))


def kind_of(x: Column) -> Column:
    """The kind of a found value, or null if it isn't valid."""
    digits = _digits(x)
    octets = F.split(x, r"\.")
    return (
        F.when(F.instr(x, "@") > 0, "mail")
        .when(x.rlike(f"^(?:{DATE})$".replace(r"\2", r"\1").replace(r"\3", r"\2")), F.when(_day(x).isNotNull(), "date"))
        .when(x.rlike(f"^{IP}$"), F.when(F.forall(octets, lambda o: o.cast("int") <= 255), "ip"))
        .when(x.rlike(f"^{SSN}$"), F.when(~x.rlike("^(000|666|9)") & (F.substring(x, 5, 2) != "00") & (F.substring(x, 8, 4) != "0000"), "ssn"))
        .when(x.rlike(f"^{CARD}$") & ~x.rlike(r"^\+"), F.when(_luhn_valid(digits), "card"))
        .when(F.length(digits).between(7, 15), "phone")
    )


def _luhn_valid(digits: Column) -> Column:
    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    return (_check_digit(body) == F.substr(digits, F.length(digits), F.lit(1))) & ~digits.rlike("^0+$")


def _ssn_place(digits: Column) -> Column:
    """The place of a valid number among the valid ones: areas 001-899 without 666, groups 01-99, serials 0001-9999."""
    area, group, serial = (F.substring(digits, at, n).cast("long") for at, n in ((1, 3), (4, 2), (6, 4)))
    return ((area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1) * 9999 + serial - 1


def _ssn_at(place: Column) -> Column:
    area = F.floor(place / (99 * 9999)).cast("long") + 1
    part = lambda n, many: F.lpad(n.cast("string"), many, "0")
    return F.concat(part(area + F.when(area >= 666, 1).otherwise(0), 3), part(F.pmod(F.floor(place / 9999).cast("long"), F.lit(99)) + 1, 2), part(F.pmod(place, F.lit(9999)) + 1, 4))


def _value(groups: Column, i: Column, j: Column) -> Column:
    """struct(rank, less, j, x, kind) of the groups i to j of a run as one value; null if they aren't one."""

    def judged(x: Column) -> Column:
        joined = F.get(groups, i - 2).rlike("[0-9]-$") | F.get(groups, j - 1).rlike("[0-9]-$")
        whole = ~F.coalesce(joined, F.lit(False))  # not the end or start of a longer number
        return _let(kind_of(x), lambda kind: ranked(x, kind, whole))

    def ranked(x: Column, kind: Column, whole: Column) -> Column:
        sound = (kind == "card") | (whole & ((kind != "phone") | x.rlike(f"^(?:{PHONE})$")))
        rank = F.when(kind == "card", 1).when(kind == "phone", 2).otherwise(0)
        return F.when(sound, F.struct(rank.alias("rank"), (-j).alias("less"), j.alias("j"), x.alias("x"), kind.alias("kind")))

    return _let(F.regexp_replace(F.array_join(F.slice(groups, i, j - i + 1), ""), "[ -]+$", ""), judged)


def _pieces(run: Column) -> Column:
    """A run cut into structs (x, kind), kind null between values."""
    piece = "array<struct<x:string,kind:string>>"
    literal = lambda x: F.struct(x.alias("x"), F.lit(None).cast("string").alias("kind"))

    def read(groups: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            found = F.array_min(F.filter(F.transform(F.sequence(i, F.least(F.size(groups), i + 18)), lambda j: _value(groups, i, j)), lambda v: v.isNotNull()))

            def take(v: Column) -> Column:
                after = literal(F.regexp_extract(F.get(groups, v["j"] - 1), "[ -]*$", 0))
                value = F.array(F.struct(v["x"].alias("x"), v["kind"].alias("kind")), after)
                return F.struct(
                    F.coalesce(v["j"] + 1, i + 1).alias("next"),
                    F.concat(acc["out"], F.when(v.isNotNull(), value).otherwise(F.array(literal(F.get(groups, i - 1)))).cast(piece)).alias("out"),
                )

            return F.when(i < acc["next"], acc).otherwise(_let(found, take))

        start = F.struct(F.lit(1).alias("next"), F.array().cast(piece).alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.size(groups)), start, step, lambda acc: acc["out"])

    return _let(F.regexp_extract_all(run, F.lit("([0-9]+[ -]*)"), F.lit(1)), read)


def _cut(m: Column) -> Column:
    """A match cut into structs (x, kind)."""
    one = lambda kind: F.array(F.struct(m.alias("x"), kind.alias("kind")))
    return _let(kind_of(m), lambda kind: F.when(m.rlike(f"^{RUN}$") & ~F.coalesce(kind.isin("date", "ssn"), F.lit(False)), _pieces(m)).otherwise(one(kind)))


def pseudonym(x: Column, kind: Column, key: str, inverse: bool = False) -> Column:
    """The value of the same format for a value of that kind; a value without a kind stays."""
    digits = _digits(x)
    body = _let(F.substr(digits, F.lit(1), F.length(digits) - 1), lambda d: permute_text(d, key, "card", inverse))
    card = _into(x, _let(body, lambda b: F.concat(b, _check_digit(b))))
    ssn = _into(x, _let(permute_number(_ssn_place(digits), AREAS * 99, 9999, key, "ssn", inverse), _ssn_at))
    code = F.regexp_extract(x, r"^(\+[0-9]{1,3}(?![0-9])[ .-]?)", 1)
    local = F.substr(x, F.length(code) + 1)
    phone = _let(local, lambda rest: F.concat(code, _into(rest, permute_text(_digits(rest), key, "phone", inverse))))
    at = F.instr(x, "@")
    mail = F.concat(_let(F.substr(x, F.lit(1), at - 1), lambda name: permute_text(name, key, "mail", inverse)), F.substr(x, at))
    o = F.transform(F.split(x, r"\."), lambda c: c.cast("long"))
    number = permute_number(((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3], 1 << 16, 1 << 16, key, "ip", inverse)
    ip = _let(number, lambda n: F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]))
    first = F.lit("1600-01-01").cast("date")
    span = lambda nth: F.floor(nth / 146097).cast("int") * 146097
    new = _let(F.datediff(_day(x), first), lambda nth: F.date_add(first, (span(nth) + permute_number((nth - span(nth)).cast("long"), 189, 773, key, "date", inverse)).cast("int")))
    compact = F.date_format(new, "yyyyMMdd")
    date = _into(x, F.when(x.rlike("^[0-9]{4}[-/.]"), compact).otherwise(F.concat(F.substring(compact, 7, 2), F.substring(compact, 5, 2), F.substring(compact, 1, 4))))
    return F.when(kind == "card", card).when(kind == "ssn", ssn).when(kind == "phone", phone).when(kind == "mail", mail).when(kind == "ip", ip).when(kind == "date", date).otherwise(x)


def _count(kind: str) -> Column:
    return F.size(F.filter("__k", lambda k: k == kind))


def pseudonymise(docs: DataFrame, key: str, inverse: bool = False) -> DataFrame:
    """``docs`` with valid values in ``text`` replaced, and pseudonyms: how many of each kind.

    No shuffle: one pass over the texts; only texts with a match are split.
    """
    docs = docs.drop("pseudonyms")
    found = docs.withColumn("__m", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(1)))
    plain = lambda p: F.array(F.struct(p.alias("x"), F.lit(None).cast("string").alias("kind")))
    parts = F.flatten(F.zip_with(F.split("text", PATTERN, -1), F.transform("__m", _cut), lambda p, c: F.when(c.isNull(), plain(p)).otherwise(F.concat(plain(p), c))))
    cut = found.withColumn("__p", F.when(F.size("__m") > 0, parts)).withColumn("__k", F.transform("__p", lambda p: p["kind"]))
    whole = F.transform("__p", lambda p: pseudonym(p["x"], p["kind"], key, inverse))
    text = F.when(F.exists("__k", lambda k: k.isNotNull()), F.array_join(whole, "")).otherwise(F.col("text"))
    counts = F.struct(*[F.coalesce(_count(kind), F.lit(0)).cast("long").alias(kind) for kind in KINDS])
    out = cut.withColumn("__text", text).withColumn("pseudonyms", F.when(F.size("__m") > 0, counts).otherwise(F.struct(*[F.lit(0).cast("long").alias(k) for k in KINDS])))
    return out.select(*(F.col("__text").alias("text") if c == "text" else F.col(c) for c in docs.columns), "pseudonyms")
