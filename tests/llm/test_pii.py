import datetime
import hashlib
import random
import re

from pyspark.sql import functions as F

from tagweave.llm import pii

KEY = "test key"


def luhn(d):
    return sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for k, c in enumerate(reversed(d))) % 10 == 0


VALID = {
    "card": ["4111111111111111", "5500 0000 0000 0004", "3400-0000-0000-009", "6011000990139424"],
    "ssn": ["123-45-6789"], "phone": ["+1 (487) 555-7209", "(017) 555-7713", "555-123-4567", "+49 30 123456"],
    "ip": ["192.168.0.1", "8.8.8.8", "255.255.255.255"], "mail": ["und.34@mail7.example.com", "A_b+c9@x.org", "z@y.co"],
    "date": ["2024-02-29", "31/12/1999", "01.01.1600", "2399-12-31"],
}
INVALID = ["4111111111111112", "000-12-3456", "256.1.1.1", "2023-02-29", "1234-13-01", "no@dots", "12345", "1.2.3.4.5", "a4111111111111111"]


def both(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "text string").coalesce(1)
    out = pii.pseudonymise(df, KEY)
    back = pii.pseudonymise(out, KEY, inverse=True)
    return [r.text for r in out.collect()], [r.text for r in back.collect()], [r.pseudonyms for r in out.collect()]


def test_valid_values_keep_their_format_and_can_be_inverted(spark):
    flat = [(kind, v) for kind, vs in VALID.items() for v in vs]
    new, back, counts = both(spark, [v for _, v in flat])
    for (kind, old), x, y, n in zip(flat, new, back, counts, strict=True):
        assert n[kind] == 1 and sum(n) == 1, (old, n)
        assert x != old
        if kind != "ip":
            assert re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", x))) == re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", old)))
        if kind == "card":
            assert luhn(re.sub("[^0-9]", "", x))
        if kind == "ip":
            assert all(0 <= int(o) <= 255 for o in x.split("."))
        if kind == "date":
            datetime.date(*(int(p) for p in (re.split("[-/.]", x) if x[4] in "-/." else re.split("[-/.]", x)[::-1])))
        assert y == old, (old, x, y)


def test_invalid_values_stay(spark):
    assert both(spark, INVALID)[0] == INVALID


def test_values_are_found_in_texts_and_stay_linked(spark):
    rng = random.Random(1)
    parts = [v for vs in VALID.values() for v in vs] + INVALID
    texts = ["é ".join([rng.choice(["word", "###", "\n", "$$$ x"]) + " " + rng.choice(parts) + rng.choice([".", ",", " ", "!!", "$$$", "\n"]) for _ in range(rng.randint(0, 9))]) for _ in range(60)]
    new = dict(zip(parts, both(spark, parts)[0], strict=True))
    pattern = re.compile(pii.PATTERN)
    want = [pattern.sub(lambda m: new.get(m[0], m[0]), t) for t in texts]
    assert both(spark, texts)[0] == want


def digest(kind, step, half):
    return hashlib.sha256(f"{KEY}|{kind}|{step}|{half}".encode()).hexdigest()


def plain_text(x, kind):
    """Feistel rounds over digits and letters."""
    def turn(half, d):
        out = ""
        for j, c in enumerate(half):
            k = int(d[j % 32 * 2 : j % 32 * 2 + 2], 16)
            for base, n in ((48, 10), (97, 26), (65, 26)):
                if base <= ord(c) < base + n:
                    c = chr((ord(c) - base + k) % n + base)
                    break
            out += c
        return out

    left, right = x[: len(x) // 2], x[len(x) // 2 :]
    for i in range(1, 9):
        if i % 2:
            right = turn(right, digest(kind, i, left))
        else:
            left = turn(left, digest(kind, i, right))
    return left + right


def plain_number(x, a, b, kind):
    left, right = divmod(x, b)
    for i in range(1, 9):
        if i % 2:
            right = (right + int(digest(kind, i, left)[:15], 16)) % b
        else:
            left = (left + int(digest(kind, i, right)[:15], 16)) % a
    return left * b + right


def fill(form, digits):
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


def plain_pseudonym(kind, x):
    digits = re.sub("[^0-9]", "", x)
    if kind == "card":
        body = plain_text(digits[:-1], "card")
        return fill(x, body + next(c for c in "0123456789" if luhn(body + c)))
    if kind == "ssn":
        every = [a for a in range(1, 900) if a != 666]
        place = plain_number((every.index(int(digits[:3])) * 99 + int(digits[3:5]) - 1) * 9999 + int(digits[5:]) - 1, 898 * 99, 9999, "ssn")
        rest, serial = divmod(place, 9999)
        return f"{every[rest // 99]:03}-{rest % 99 + 1:02}-{serial + 1:04}"
    if kind == "phone":
        code = re.match(r"(\+[0-9]{1,3}(?![0-9])[ .-]?)?", x)[0]
        rest = x[len(code) :]
        return code + fill(rest, plain_text(re.sub("[^0-9]", "", rest), "phone"))
    if kind == "mail":
        name, _, domain = x.partition("@")
        return plain_text(name, "mail") + "@" + domain
    if kind == "ip":
        n = plain_number(int.from_bytes(bytes(map(int, x.split("."))), "big"), 1 << 16, 1 << 16, "ip")
        return ".".join(map(str, n.to_bytes(4, "big")))
    parts = re.split("[-/.]", x)
    first = datetime.date(1600, 1, 1)
    nth = (datetime.date(*map(int, parts if len(parts[0]) == 4 else parts[::-1])) - first).days
    new = first + datetime.timedelta(nth // 146097 * 146097 + plain_number(nth % 146097, 189, 773, "date"))
    return fill(x, f"{new:%Y%m%d}" if len(parts[0]) == 4 else f"{new:%d%m%Y}")


def test_pseudonyms_equal_plain_python_and_can_be_inverted(spark):
    rng = random.Random(5)
    values = [(kind, v) for kind, vs in VALID.items() for v in vs]
    areas = [1, 665, 667, 899]
    values += [("ssn", f"{a:03}-{g:02}-{s:04}") for a in areas for g in (1, 99) for s in (1, 9999)]
    values += [("ssn", f"{rng.choice([a for a in range(1, 900) if a != 666]):03}-{rng.randint(1, 99):02}-{rng.randint(1, 9999):04}") for _ in range(200)]
    values += [("date", str(datetime.date(1600, 1, 1) + datetime.timedelta(rng.randrange(146097 * 2)))) for _ in range(60)]
    values += [("ip", ".".join(str(rng.randrange(256)) for _ in range(4))) for _ in range(60)]
    values += [("phone", f"({rng.randrange(1000):03}) {rng.randrange(1000):03}-{rng.randrange(10000):04}") for _ in range(60)]
    for _ in range(60):
        body = "".join(rng.choice("0123456789") for _ in range(15))
        values.append(("card", body + next(c for c in "0123456789" if luhn("4" + body[1:] + c))))
        values[-1] = ("card", "4" + values[-1][1][1:])
    new, back, counts = both(spark, [v for _, v in values])
    for (kind, old), x, y, n in zip(values, new, back, counts, strict=True):
        assert n[kind] == 1 and sum(n) == 1 and x == plain_pseudonym(kind, old) and y == old, (kind, old, x, y)
    ssns = [x for (kind, _), x in zip(values, new, strict=True) if kind == "ssn"]
    assert all(re.fullmatch(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}", x) for x in ssns)


def test_permutations_are_bijective(spark):
    df = spark.range(189 * 5).select(pii.permute_number(F.col("id"), 189, 5, KEY, "t").alias("p"))
    assert sorted(r.p for r in df.collect()) == list(range(189 * 5))
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("x")).select(pii.permute_text(F.col("x"), KEY, "t").alias("p"))
    assert len({r.p for r in df.collect()}) == 1000


def test_edges(docs):
    rows = [(1, None), (2, ""), (3, "a" * 100_000 + " 8.8.8.8"), (4, "8.8.8.8"), (4, "8.8.8.8")]
    df = docs(rows).withColumn("pseudonyms", F.lit("x"))
    out = pii.pseudonymise(df, KEY)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert len(got) == 5 and (1, None) in got and (2, "") in got and out.columns == ["doc_id", "text", "lang", "source", "n_chars", "pseudonyms"]
    assert len({t.split()[-1] for d, t in got if d in (3, 4)}) == 1
    assert pii.pseudonymise(docs([]), KEY).count() == 0
    assert "Python" not in out._jdf.queryExecution().toString()


def test_values_beside_other_numbers(spark):
    card, phone = "4111 1111 1111 1111", "555-123-4567"
    cases = {
        f"{card} 123": (f"{card}", "card"), "4111111111111111 12": ("4111111111111111", "card"), "4111-1111-1111-1111-123": ("4111-1111-1111-1111", "card"),
        f"12 {card}": (card, "card"), f"{phone} 100 times": (phone, "phone"), f"100 {phone}": (phone, "phone"), f"{phone} 100 200 300": (phone, "phone"),
        "77 123-45-6789 1234": ("123-45-6789", "ssn"), f"{card} 123 45 67": (card, "card"),
    }
    new, back, counts = both(spark, list(cases))
    alone = dict(zip((v for v, _ in cases.values()), both(spark, [v for v, _ in cases.values()])[0], strict=True))
    for (old, (value, kind)), x, n in zip(cases.items(), new, counts, strict=True):
        assert x == old.replace(value, alone[value]) and n[kind] == 1 and sum(n) == 1, (old, x, n)
    two = f"{card} 555 123 4567 x {phone}  {card}"
    x = both(spark, [two])
    assert x[2][0]["card"] == 2 and x[2][0]["phone"] == 2 and card not in x[0][0] and "555" not in x[0][0].split("x")[0][19:23]
    assert both(spark, ["1" * 50_000, "4111 1111 1111 1112 12"])[0] == ["1" * 50_000, "4111 1111 1111 1112 12"]
