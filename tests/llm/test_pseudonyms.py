"""The native expressions against a plain restatement, and what pseudonyms must keep."""

import datetime
import hashlib
import random
import re

import pytest

from tidepool.llm import pseudonyms as P

KEY = "a key of these tests"


@pytest.fixture(autouse=True)
def key(spark):
    spark.conf.set(P.KEY_SETTING, KEY)
    yield
    spark.conf.unset(P.KEY_SETTING)


def feistel(tweak, l, r, a, b):  # noqa: E741
    for i in range(1, P.ROUNDS + 1):
        def f(v, i=i):
            return int(hashlib.sha256(f"{KEY}|{tweak}|{i}|{v}".encode()).hexdigest()[:14], 16)

        if i % 2:
            l = (l + f(r)) % a  # noqa: E741
        else:
            r = (r + f(l)) % b
    return l, r


def digits(tweak, d):
    h = len(d) // 2
    l, r = feistel(f"{tweak}{len(d)}", int(d[:h] or 0), int(d[h:] or 0), 10**h, 10 ** (len(d) - h))  # noqa: E741
    return (str(l).zfill(h) if h else "") + (str(r).zfill(len(d) - h) if d else "")


def fill(shape, new):
    it = iter(new)
    return "".join(next(it) if c in "0123456789" else c for c in shape)


def luhn(payload):
    s = 0
    for k, c in enumerate(reversed(payload)):
        x = int(c) * (2 if k % 2 == 0 else 1)
        s += x - 9 if x > 9 else x
    return str(-s % 10)


def mod97(t):
    return int("".join(str(int(c, 36)) for c in t if c.isalnum())) % 97


def one(m):
    only = re.sub("[^0-9]", "", m)
    if "@" in m:
        keep = m.rindex(".")
        x, last = m[:keep].lower(), m[keep + 1 :].lower()
        l, r = x[: len(x) // 2], x[len(x) // 2 :]  # noqa: E741

        def moved(half, other, i):
            stream = "".join(hashlib.sha256(f"{KEY}|email|{last}|{i}|{k}|{other}".encode()).hexdigest() for k in (0, 1))
            out = []
            for p, c in enumerate(half):
                n = int(stream[4 * p % 128 : 4 * p % 128 + 4], 16)
                out.append(str((int(c) + n) % 10) if c in "0123456789" else chr(97 + (ord(c) - 97 + n) % 26) if "a" <= c <= "z" else c)
            return "".join(out)

        for i in range(1, P.ROUNDS + 1):
            if i % 2:
                l = moved(l, r, i)  # noqa: E741
            else:
                r = moved(r, l, i)
        return "".join(c.upper() if o.isupper() else c for c, o in zip(l + r, m, strict=False)) + m[keep:]
    if m[0].isalpha():
        c = m.replace(" ", "")
        if not 15 <= len(c) <= 34 or mod97(c[4:] + c[:4]) != 1:
            return m
        body = fill(c[4:], digits("iban" + c[:2], re.sub("[^0-9]", "", c[4:])))
        return m[:2] + fill(m[2:], str(98 - mod97(body + c[:2] + "00")).zfill(2) + re.sub("[^0-9]", "", body))
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m):
        o = list(map(int, m.split(".")))
        if max(o) > 255:
            return m
        l, r = feistel("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)  # noqa: E741
        return f"{l // 256}.{l % 256}.{r // 256}.{r % 256}"
    for shape, pattern in (("%Y-%m-%d", r"\d{4}-\d\d-\d\d"), ("%Y/%m/%d", r"\d{4}/\d\d/\d\d"), ("%d.%m.%Y", r"\d\d\.\d\d\.\d{4}"), ("%d/%m/%Y" if m[:2] > "12" else "%m/%d/%Y", r"\d\d/\d\d/\d{4}")):
        if re.fullmatch(pattern, m):
            try:
                day = datetime.datetime.strptime(m, shape).date()
            except ValueError:
                return m
            if not 1000 <= day.year <= 8999:
                return m
            era = (day.year - 1000) // 200
            start, end = datetime.date(1000 + 200 * era, 1, 1), datetime.date(1200 + 200 * era, 1, 1)
            n, new = (day - start).days, None
            while new is None or shape == "%d/%m/%Y" and new.day <= 12:
                l, r = feistel(f"date{era}", n // 270, n % 270, 271, 270)  # noqa: E741
                n = l * 270 + r
                new = start + datetime.timedelta(n) if n < (end - start).days else None
            return shape.replace("%Y", f"{new.year:04d}").replace("%m", f"{new.month:02d}").replace("%d", f"{new.day:02d}")
    if m[0] in "+(" or re.fullmatch(r"\d{3}[.-]\d{3}[.-]\d{4}", m):
        if not 8 <= len(only) <= 15:
            return m
        h = 1 if m.startswith("+1") and len(only) == 11 else 2 if m[0] == "+" else 0
        n = only[h:]
        if h < 2 and re.fullmatch(r"[2-9]\d\d[2-9]\d{6}", n):
            l, r = feistel("phone", int(n[:3]) - 200, (int(n[3:6]) - 200) * 10000 + int(n[6:]), 800, 8_000_000)  # noqa: E741
            new = f"{l + 200}{r // 10000 + 200}{r % 10000:04d}"
        else:
            new = digits("phone" + only[:h], n)
        return fill(m, only[:h] + new)
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
        a, g, s = map(int, m.split("-"))
        if not (1 <= a <= 899 and a != 666 and g and s):
            return m
        l, r = feistel("ssn", a - 1 - (a > 666), (g - 1) * 9999 + s - 1, 898, 989901)  # noqa: E741
        return f"{l + 1 + (l >= 665):03d}-{r // 9999 + 1:02d}-{r % 9999 + 1:04d}"
    if not 13 <= len(only) <= 19 or luhn(only[:-1]) != only[-1]:
        return m
    new = only[0] + digits("card", only[1:-1])
    return fill(m, new + luhn(new))


IBAN_LENGTHS = {c: n for n, cs in P._IBAN_LENGTHS.items() for c in cs.split()}


def ends(pattern, text, i, before, after):
    """Where a match of pattern at i ends, if what stands around it isn't of the same kind."""
    if i and re.match(before, text[i - 1]):
        return None
    m = re.compile(rf"(?:{pattern})(?!{after})").match(text, i)
    return m and m.end()


def iban_end(text, i):
    if i and text[i - 1].isascii() and text[i - 1].isalnum() or not re.match("[A-Z]{2}[0-9]{2}", text[i : i + 4]):
        return None

    def body(n):
        for m in (re.compile(f"[A-Z0-9]{{{n}}}").match(text, i + 4), re.compile("(?: [A-Z0-9]{4})" * (n // 4) + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "")).match(text, i + 4)):
            if m and not re.match("[A-Za-z0-9]", text[m.end() : m.end() + 1]):
                return m.end()
        return None

    told = body(IBAN_LENGTHS[text[i : i + 2]] - 4) if text[i : i + 2] in IBAN_LENGTHS else None
    return told or ends(r"[A-Z]{2}\d\d(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)", text, i, "[A-Za-z0-9]", "[A-Za-z0-9]")


def end_of(text, i):
    """Where the first kind's candidate that starts at i ends."""
    word = "[0-9A-Za-z]"
    return (
        ends(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text, i, "[A-Za-z0-9._%+-]", "(?!)")
        or iban_end(text, i)
        or ends(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", text, i, "[0-9A-Za-z.]", rf"{word}|\.\d")
        or ends(r"\d{4}-\d\d-\d\d|\d{4}/\d\d/\d\d|\d\d/\d\d/\d{4}|\d\d\.\d\d\.\d{4}", text, i, "[0-9A-Za-z./-]", rf"{word}|[./-]\d")
        or ends(r"(?:\+1[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}", text, i, "[0-9A-Za-z+]", word)
        or ends(r"(?:\+1[ .-]?)?\d{3}(?:\.\d{3}\.|-\d{3}-)\d{4}", text, i, "[0-9A-Za-z+]", word)
        or ends(r"\+1[ .-]?\d{3}[ .-]?\d{3}[ .-]?\d{4}", text, i, "[0-9A-Za-z+]", word)
        or ends(r"\+[1-9](?:\)?[ .-]?\(?\d){7,14}\)?", text, i, "[0-9A-Za-z+]", word)
        or ends(r"\d{3}-\d\d-\d{4}", text, i, "[0-9A-Za-z-]", rf"{word}|-\d")
        or ends(r"\d{13,19}|\d{4} \d{4} \d{4} \d{1,7}|\d{4}-\d{4}-\d{4}-\d{1,7}|\d{4} \d{6} \d{4,5}|\d{4}-\d{6}-\d{4,5}", text, i, word, word)
    )


def plain(text):
    """Candidates from left to right, each found without the module's pattern."""
    if text is None or not re.search("[0-9@]", text):
        return text
    out, i = [], 0
    starts = re.compile("[A-Za-z0-9._%+(-]")
    while i < len(text):
        end = end_of(text, i) if starts.match(text[i]) else None
        out.append(one(text[i:end]) if end else text[i])
        i = end or i + 1
    return "".join(out)


CASES = [
    "call +1 (269) 555-3296 4524132264652876 now", "bosbt.42@mail8.example.com, a.B-c@x.org.", "ip 42.144.35.254. and 999.1.1.1 v1.2.3.4 1.2.3.4.5",
    "4111 1111 1111 1111 and 4111-1111-1111-1111 and 4111111111111112 x4111111111111111", "DE89 3704 0044 0532 0130 00 GB82WEST12345698765432 GB82WEST12345698765433",
    "2024-02-29 2023-02-29 31/12/1999 12/31/1999 01.02.2003 1850/07/04 99/99/2000 0999-01-01", "123-45-6789 000-12-3456 666-12-1234 899-99-9999 667-01-0001",
    "+44 20 7946 0958; 555-123-4567 (212) 555-0100 +49 (89) 1234-5678 +1 234 5678 +12", None, "", "nothing", "378282246310005 3782 822463 10005", "é@x.de a@b @c d@e.f. " + "q" * 5_000 + "@", "1" * 3_000 + " 4111111111111111",
]


def test_every_kind_against_the_restatement(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in P.pseudonymise(df).collect()}
    assert got == {i: plain(t) for i, t in enumerate(CASES)}
    changed = [t for i, t in enumerate(CASES) if got[i] != t]
    assert len(changed) == 11


def test_whole_table_against_the_restatement(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = P.pseudonymise(docs).collect()
    assert len(rows) == len(texts) and sum(r.n_email + r.n_phone + r.n_card + r.n_ip for r in rows) > 20
    for r in rows:
        assert r.text == plain(texts[r.doc_id]) and len(r.text) == len(texts[r.doc_id]) or r.n_ip
        n = sum(r[f"n_{k}"] for k in P.KINDS)
        assert (r.text == texts[r.doc_id]) == (n == 0)


@pytest.mark.parametrize("kind", ["ssn", "ip", "card", "email"])
def test_values_stay_different_and_valid(spark, kind):
    rng = random.Random(6)
    if kind == "ssn":
        values = {f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}" for _ in range(300)}
    elif kind == "ip":
        values = {f"10.0.{rng.randint(0, 255)}.{rng.randint(0, 255)}" for _ in range(300)}
    elif kind == "email":
        values = {f"{a}@{b}.com" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"} | {f"{rng.choice(['Ann', 'ann', 'bob.x'])}{rng.randrange(99)}@mail.org" for _ in range(300)}
    else:
        values = {p + luhn(p) for p in (f"4{rng.randrange(10**14):014d}" for _ in range(300))}
    df = spark.createDataFrame([(i, f"a {v} b") for i, v in enumerate(sorted(values))], "doc_id long, text string")
    once = P.pseudonymise(df).collect()
    fixed = 3 if kind == "email" else 0  # a permutation of 676 addresses has about one fixed point, which counts as no change
    assert len({r.text for r in once}) == len(values) and sum(r[f"n_{kind}"] != 1 for r in once) <= fixed
    twice = P.pseudonymise(spark.createDataFrame([(r.doc_id, r.text) for r in once], "doc_id long, text string")).collect()
    assert sum(r[f"n_{kind}"] != 1 for r in twice) <= fixed  # pseudonyms are valid values themselves
    other = P.pseudonymise(df, key="another").collect()
    assert {r.text for r in other} != {r.text for r in once}


@pytest.mark.parametrize(("shape", "years"), [("%m/%d/%Y", (1900, 2100)), ("%d/%m/%Y", (1900, 2100)), ("%Y-%m-%d", (1000, 1001)), ("%d.%m.%Y", (8998, 8999)), ("%Y/%m/%d", (1999, 2000))])
def test_dates_stay_different_and_valid(spark, shape, years):
    """Every day in a notation; slash dates in both, as strings of one kind."""
    days = [datetime.date(years[0], 1, 1) + datetime.timedelta(i) for i in range((datetime.date(years[1], 12, 31) - datetime.date(years[0], 1, 1)).days + 1)]
    shapes = {shape, "%m/%d/%Y"} if shape.endswith("/%Y") else {shape}
    values = sorted({one.replace("%Y", f"{d.year:04d}").replace("%m", f"{d.month:02d}").replace("%d", f"{d.day:02d}") for d in days for one in shapes})
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")
    once = P.pseudonymise(df)
    got = [r.text for r in once.collect()]
    # Each permutation (of an era, in either class of slash dates) has about one fixed point, which counts as no change.
    assert len(set(got)) == len(values) and once.where("n_date <> 1").count() <= 12
    twice = P.pseudonymise(once.select("doc_id", "text"))
    assert twice.where("n_date <> 1").count() <= 12 and {r.text for r in twice.collect()} != set()


def test_an_address_has_one_pseudonym_whatever_its_case(spark):
    df = spark.createDataFrame([(0, "ann.b@mail.org"), (1, "Ann.B@MAIL.org")], "doc_id long, text string")
    a, b = (r.text for r in P.pseudonymise(df).orderBy("doc_id").collect())
    assert a == b.lower() and b[0].isupper() and b[4].isupper() and a != "ann.b@mail.org"


def test_a_key_is_needed(spark, odd_docs):
    spark.conf.unset(P.KEY_SETTING)
    with pytest.raises(ValueError, match="key"):
        P.pseudonymise(odd_docs)
    assert P.key_of(spark, "x") == "x"


def test_odd_documents(odd_docs, no_docs):
    got = P.pseudonymise(odd_docs, counts=False)
    assert got.columns == odd_docs.columns
    assert sorted(str(r.text) for r in got.collect()) == sorted(str(r.text) for r in odd_docs.collect())
    assert P.pseudonymise(odd_docs).select("n_card").distinct().first()[0] == 0
    assert P.pseudonymise(odd_docs).columns == [c for c in odd_docs.columns if c != "n_card"] + [f"n_{k}" for k in P.KINDS]
    assert P.pseudonymise(no_docs).count() == 0


def test_the_plan_has_no_python(spark, odd_docs):
    plan = P.pseudonymise(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize(("value", "kind"), [("BE68 5390 0754 7034", "iban"), ("ES91 2100 0418 4502 0005 1332", "iban"), ("AT61 1904 3002 3457 3201", "iban"), ("DE89 3704 0044 0532 0130 00", "iban"), ("NO93 8601 1117 947", "iban"), ("+44 20 7946 0958", "phone"), ("+4420794609581", "phone")])
def test_what_follows_a_value_does_not_hide_it(spark, value, kind):
    tails = ["", " BIC GEBABEBB", " 2024", " BIC", " X", " 2024 2025", ".", " 2024-01-05"]
    if value == "+4420794609581":
        tails = ["", " BIC", " 2024"]
    df = spark.createDataFrame([(i, f"pay {value}{t}") for i, t in enumerate(tails)], "doc_id long, text string")
    for r in P.pseudonymise(df).collect():
        assert r[f"n_{kind}"] == 1 and value not in r.text, r.text
        assert r.n_date == tails[r.doc_id].count("-01-")
        assert r.text == plain(f"pay {value}{tails[r.doc_id]}")


def test_addresses_of_very_many_labels_stay_and_end_nothing(spark):
    """No address is longer than 320 characters; looking for it must not recurse by label."""
    long = "x@" + "a." * 100_000 + "com"
    mix = f"{long} and bob@example.org, tel. 555-123-4567"
    got = spark.createDataFrame([(long,), (mix,)], "text string")
    a, b = (r.text for r in P.pseudonymise(got, "key", counts=False).collect())
    assert a == long and b.startswith(long) and "bob@" not in b


@pytest.mark.parametrize("unit", ["+1 ", "(555) ", "1.", "12-", "12/", "AB12 ", "1234 ", "a.b@", "@", "a@b.", "+12)(3 "])
def test_long_runs_of_what_patterns_begin_with(spark, unit):
    text = unit * 60_000
    assert P.pseudonymise(spark.createDataFrame([(text,)], "text string"), "key", counts=False).count() == 1
    got = P.pseudonymise(spark.createDataFrame([(text + "x",)], "text string"), "key", counts=False).first().text
    assert len(got) == len(text) + 1
