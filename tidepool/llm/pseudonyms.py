"""Format-preserving pseudonyms: personal numbers, dates and addresses are permuted within their format under a key.

A value is split into two halves; rounds of an alternating Feistel network add a keyed digest of one to
the other, modulo its size, so the result is a permutation of all values of the format: equal values keep
equal pseudonyms across documents, different ones stay different, and pseudonyms are valid values again.

kind   what counts as valid                                   what is permuted
card   13 to 19 digits, plain or grouped, whose Luhn sum fits all but the first digit; check digit anew
iban   country, two check digits, its length; mod 97 is 1     the digits after the check digits; these anew
ip     four numbers from 0 to 255                             all 32 bits
ssn    ddd-dd-dddd outside the ranges never issued            the index among the valid numbers
phone  North American, or + and 8 to 15 digits                all but the country code, within the plan's ranges
date   a day of the years 1000 to 8999, in four notations     the day within its era of 200 years
email  local@domain.tld                                       letters and digits but for the last label, whatever its case

Eras and the slash dates that only read day first (the first number above 12) aren't products of two
sizes: there the permutation of a larger domain is repeated until it lands in them again, which is a
permutation too. Slash dates up to 12 read month first and stay so; a day has one pseudonym in all notations
but day-first slashes. An address is permuted within its pattern of letters, digits and marks.

The key is the setting spark.tidepool.pseudonym.key unless the caller names one; there is no default, as
whoever knows the key can invert the permutation. It is part of the plan: keep plans and event logs private.

DataFrame functions only; lengths, separators and everything around the values stay as they are.

Defined cases: null text stays null with counts of 0, empty text stays empty; invalid look-alikes stay;
overlapping candidates are settled leftmost first, then in the order email, iban, ip, date, phone, ssn, card;
an IBAN ends at its country's length and a phone number by its 15th digit, whatever follows; an address of more than 320
characters is none; equal rows and
null ids are rows like any other; input columns named n_<kind> give way to the counts, where these are asked
for, and all others pass. Patterns have no unbounded backtracking or recursion, so long texts cost what short ones do a
byte. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import shielded

KEY_SETTING = "spark.tidepool.pseudonym.key"
#: For demonstrations and tests on made-up data only: it is public, so it hides nothing.
DEMONSTRATION_KEY = "tidepool"
ROUNDS = 10
MOST_ADDRESS = 320  # characters of an e-mail address: 64, the sign and 255
KINDS = ("email", "iban", "ip", "date", "phone", "ssn", "card")
#: Countries by the length of their IBANs, from the registry; those that aren't here are matched at any length.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_body(n: int) -> str:
    """n characters after country and check digits, plain or in groups of four."""
    rest = f" [A-Z0-9]{{{n % 4}}}" if n % 4 else ""
    return f"(?:[A-Z0-9]{{{n}}}|(?: [A-Z0-9]{{4}}){{{n // 4}}}{rest})"


_IBANS = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}{_iban_body(n - 4)}(?![A-Za-z0-9])" for n, c in _IBAN_LENGTHS.items())
_PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "iban": rf"(?<![A-Za-z0-9])(?:{_IBANS}|[A-Z]{{2}}[0-9]{{2}}(?:[A-Z0-9]{{11,30}}|(?: [A-Z0-9]{{4}}){{2,7}}(?: [A-Z0-9]{{1,3}})?))(?![A-Za-z0-9])",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9A-Za-z]|[./-][0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:(?:\+1[ .-]?)?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|(?:\+1[ .-]?)?[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}|\+1[ .-]?[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\+[1-9](?:\)?[ .-]?\(?[0-9]){7,14}\)?)(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\3[0-9]{4,5})(?![0-9A-Za-z])",
}
PATTERN = "|".join(f"(?:{p})" for p in _PATTERNS.values())


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """body, in which name stands for value, worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _long(digits: str) -> str:
    return f"coalesce(try_cast({digits} as bigint), 0L)"


def _feistel(key: str, tweak: str, left: str, right: str, a: str, b: str) -> str:
    """A struct (l, r): the image of (left, right) among the pairs below a and b."""

    def digest(v: str) -> str:
        return f"cast(conv(substr(sha2(concat_ws('|', {_text(key)}, {tweak}, i, {v}), 256), 1, 14), 16, 10) as bigint)"

    one = f"named_struct('l', pmod(s.l + {digest('s.r')}, {a}), 'r', s.r)"
    other = f"named_struct('l', s.l, 'r', pmod(s.r + {digest('s.l')}, {b}))"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, i) -> if(i % 2 = 1, {one}, {other}))"


def _digits(key: str, tweak: str, digits: str) -> str:
    """A string of digits permuted among those of its length."""
    h = f"(length({digits}) div 2)"
    size = lambda n: f"cast(rpad('1', cast({n} + 1 as int), '0') as bigint)"
    pair = _feistel(key, f"concat({tweak}, length({digits}))", _long(f"substr({digits}, 1, {h})"), _long(f"substr({digits}, {h} + 1)"), size(h), size(f"length({digits}) - {h}"))
    return _let("q", pair, f"concat(if({h} = 0, '', lpad(cast(q.l as string), {h}, '0')), if(length({digits}) = 0, '', lpad(cast(q.r as string), length({digits}) - {h}, '0')))")


def _fill(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    step = f"if(c between '0' and '9', named_struct('o', concat(t.o, substr({digits}, t.k, 1)), 'k', t.k + 1), named_struct('o', concat(t.o, c), 'k', t.k))"
    return f"aggregate(split({shape}, ''), named_struct('o', '', 'k', 1), (t, c) -> {step}, t -> t.o)"


def _only_digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(payload: str) -> str:
    """The check digit of a payload, as a string."""
    d = f"cast(substr({payload}, j, 1) as int)"
    doubled = f"if((length({payload}) - j) % 2 = 0, 2 * {d} - if({d} > 4, 9, 0), {d})"
    return f"cast(pmod(10 - aggregate(sequence(1, length({payload})), 0, (u, j) -> u + {doubled}) % 10, 10) as string)"


def _mod97(text: str) -> str:
    """The remainder by 97 of letters (A is 10) and digits read as one number."""
    return f"aggregate(split({text}, ''), 0, (u, c) -> case when c between '0' and '9' then (u * 10 + cast(c as int)) % 97 when c between 'A' and 'Z' then (u * 100 + ascii(c) - 55) % 97 else u end)"


def _card(key: str) -> str:
    new = _let("p", f"concat(substr(d, 1, 1), {_digits(key, _text('card'), 'substr(d, 2, length(d) - 2)')})", f"concat(p, {_luhn('p')})")
    valid = f"length(d) between 13 and 19 and {_let('p', 'substr(d, 1, length(d) - 1)', _luhn('p'))} = right(d, 1)"
    return _let("d", _only_digits("m"), f"if({valid}, {_let('n', new, _fill('m', 'n'))}, m)")


def _iban(key: str) -> str:
    # c: without spaces; f: the digits after the check digits, permuted; z: check digits to go with them.
    body = _let("f", _digits(key, "concat('iban', substr(c, 1, 2))", _only_digits("substr(c, 5)")), _fill("substr(c, 5)", "f"))
    check = f"lpad(cast(98 - {_mod97('concat(b, substr(c, 1, 2), ' + _text('00') + ')')} as string), 2, '0')"
    new = _let("b", body, _let("z", f"concat({check}, {_only_digits('b')})", f"concat(substr(m, 1, 2), {_fill('substr(m, 3)', 'z')})"))
    valid = f"length(c) between 15 and 34 and {_mod97('concat(substr(c, 5), substr(c, 1, 4))')} = 1"
    return _let("c", "replace(m, ' ', '')", f"if({valid}, {new}, m)")


def _ip(key: str) -> str:
    parts = "transform(split(m, '[.]'), x -> cast(x as int))"
    new = _let("q", _feistel(key, _text("ip"), "o[0] * 256 + o[1]", "o[2] * 256 + o[3]", "65536", "65536"), "concat_ws('.', q.l div 256, q.l % 256, q.r div 256, q.r % 256)")
    return _let("o", parts, f"if(array_max(o) <= 255, {new}, m)")


def _ssn(key: str) -> str:
    parts = "transform(split(m, '-'), x -> cast(x as int))"
    pair = _feistel(key, _text("ssn"), "o[0] - 1 - if(o[0] > 666, 1, 0)", "(o[1] - 1) * 9999 + o[2] - 1", "898", "989901")
    area = "q.l + 1 + if(q.l >= 665, 1, 0)"
    new = _let("q", pair, f"concat_ws('-', lpad(cast({area} as string), 3, '0'), lpad(cast(q.r div 9999 + 1 as string), 2, '0'), lpad(cast(q.r % 9999 + 1 as string), 4, '0'))")
    return _let("o", parts, f"if(o[0] between 1 and 899 and o[0] <> 666 and o[1] > 0 and o[2] > 0, {new}, m)")


def _phone(key: str) -> str:
    # d: all digits; h: how many of them are the country code.
    code = "case when m rlike '^[+]1' and length(d) = 11 then 1 when m like '+%' then 2 else 0 end"
    national = "substr(d, h + 1)"
    pair = _feistel(key, _text("phone"), "cast(substr(n, 1, 3) as int) - 200", "(cast(substr(n, 4, 3) as int) - 200) * 10000L + cast(substr(n, 7) as int)", "800", "8000000")
    planned = _let("q", pair, "concat(cast(q.l + 200 as string), cast(q.r div 10000 + 200 as string), lpad(cast(q.r % 10000 as string), 4, '0'))")
    new = f"case when h < 2 and n rlike '^[2-9][0-9]{{2}}[2-9][0-9]{{6}}$' then {planned} else {_digits(key, 'concat(' + _text('phone') + ', substr(d, 1, h))', 'n')} end"
    filled = _let("n", national, _let("e", f"concat(substr(d, 1, h), {new})", _fill("m", "e")))
    return _let("d", _only_digits("m"), _let("h", code, f"if(length(d) between 8 and 15, {filled}, m)"))


def _date(key: str) -> str:
    # o: year, month, day; e: era, a: its first day, z: how many it has; w: the walk, until it is in the era (and, day first, past the 12th) again.
    day_first = "(m like '__/__/____' and substr(m, 1, 2) > '12')"
    ymd = f"case when m rlike '^[0-9]{{4}}' then array(substr(m, 1, 4), substr(m, 6, 2), substr(m, 9, 2)) when m like '%.%' or {day_first} then array(substr(m, 7, 4), substr(m, 4, 2), substr(m, 1, 2)) else array(substr(m, 7, 4), substr(m, 1, 2), substr(m, 4, 2)) end"
    pair = _feistel(key, "concat('date', e)", "w.n div 270", "w.n % 270", "271", "270")
    step = _let("q", pair, _let("x", "q.l * 270 + q.r", f"named_struct('n', x, 'there', x < z and (not {day_first} or day(date_add(a, cast(x as int))) > 12))"))
    moved = f"aggregate(sequence(1, 64), named_struct('n', cast(datediff(y, a) as bigint), 'there', false), (w, t) -> if(w.there, w, {step}), w -> date_add(a, cast(w.n as int)))"
    parts = "array(lpad(cast(year(g) as string), 4, '0'), lpad(cast(month(g) as string), 2, '0'), lpad(cast(day(g) as string), 2, '0'))"
    shown = f"case when m like '____-%' then concat_ws('-', d) when m like '____/%' then concat_ws('/', d) when m like '%.%' then concat_ws('.', d[2], d[1], d[0]) when {day_first} then concat_ws('/', d[2], d[1], d[0]) else concat_ws('/', d[1], d[2], d[0]) end"
    new = _let("g", moved, _let("d", parts, shown))
    new = _let("e", "cast((year(y) - 1000) div 200 as int)", _let("a", "make_date(1000 + 200 * e, 1, 1)", _let("z", "datediff(make_date(1200 + 200 * e, 1, 1), a)", new)))
    return _let("o", ymd, _let("y", "try_cast(concat_ws('-', o[0], o[1], o[2]) as date)", f"if(y is not null and o[0] between '1000' and '8999', {new}, m)"))


def _email(key: str) -> str:
    # x: all but the last label, lower-cased; f: its two halves, permuted; what was upper case is so again.
    def shifted(half: str, other: str) -> str:
        stream = "concat(" + ", ".join(f"sha2(concat_ws('|', {_text(key)}, 'email', b, i, {k}, {other}), 256)" for k in (0, 1)) + ")"
        number = "cast(conv(substr(w, 1 + (4 * p) % 128, 4), 16, 10) as int)"
        letter = f"case when c between '0' and '9' then char(48 + (ascii(c) - 48 + {number}) % 10) when c between 'a' and 'z' then char(97 + (ascii(c) - 97 + {number}) % 26) else c end"
        return _let("w", stream, f"array_join(transform(split({half}, ''), (c, p) -> {letter}), '')")

    one, other = (f"named_struct('l', {a}, 'r', {b})" for a, b in ((shifted("s.l", "s.r"), "s.r"), ("s.l", shifted("s.r", "s.l"))))
    pair = f"aggregate(sequence(1, {ROUNDS}), named_struct('l', substr(x, 1, length(x) div 2), 'r', substr(x, length(x) div 2 + 1)), (s, i) -> if(i % 2 = 1, {one}, {other}), s -> concat(s.l, s.r))"
    cased = "array_join(transform(split(f, ''), (c, p) -> if(substr(m, p + 1, 1) between 'A' and 'Z', upper(c), c)), '')"
    last = "substring_index(m, '.', -1)"
    new = _let("b", f"lower({last})", _let("x", f"lower(substr(m, 1, length(m) - length({last}) - 1))", _let("f", pair, f"concat({cased}, '.', {last})")))
    return f"if(length(m) <= {MOST_ADDRESS}, {new}, m)"


def _kind() -> str:
    """The kind of a match m, by its shape."""
    return (
        "case when contains(m, '@') then 'email' when m rlike '^[A-Z]' then 'iban' when m rlike '^[0-9]{1,3}([.][0-9]{1,3}){3}$' then 'ip' "
        "when m rlike '^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}[.][0-9]{2}[.][0-9]{4})$' then 'date' "
        "when m rlike '^[+(]' or m rlike '^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$' then 'phone' when m rlike '^[0-9]{3}-[0-9]{2}-[0-9]{4}$' then 'ssn' else 'card' end"
    )


def changed(text: str, key: str) -> Column:
    """For each candidate in a text column, a struct (m, new, kind)."""
    makers = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "phone": _phone, "ssn": _ssn, "card": _card}
    cases = " ".join(f"when {_text(k)} then {makers[k](key)}" for k in KINDS)
    one = _let("k", _kind(), f"named_struct('m', m, 'new', case k {cases} end, 'kind', k)")
    return F.expr(f"transform(regexp_extract_all({text}, {_text(PATTERN)}, 0), m -> {one})")


def key_of(spark: SparkSession, default: str | None = None) -> str:
    """The key that the session names, or the default; an error where there is neither."""
    key = spark.conf.get(KEY_SETTING, None) or default
    if not key:
        raise ValueError(f"pseudonyms need a key: set {KEY_SETTING}")
    return key


def pseudonymise(docs: DataFrame, key: str | None = None, counts: bool = True) -> DataFrame:
    """docs with text pseudonymised and, with counts, n_<kind>: how many values of each kind were replaced."""
    key = key or key_of(docs.sparkSession)
    names = [f"n_{k}" for k in KINDS] if counts else []
    docs, restored = shielded(docs.drop(*names), {"text"})
    return restored(_replaced(docs, docs.columns, key, counts), *names)


def _replaced(docs: DataFrame, columns: list[str], key: str, counts: bool) -> DataFrame:
    # Only texts with a digit or an at sign can hold a candidate; the others skip the pattern.
    some = F.when(F.col("text").rlike("[0-9@]"), changed("text", key))
    staged = docs.select(*columns, some.alias("_found"))
    gaps = F.expr(f"split(text, {_text(PATTERN)}, -1)")
    new = F.concat(F.transform("_found", lambda x: x["new"]), F.array(F.lit("")))
    text = F.when(F.size("_found") > 0, F.array_join(F.zip_with(gaps, new, lambda g, x: F.concat(g, x)), "")).otherwise(F.col("text"))

    def counted(kind: str) -> Column:
        replaced = F.filter("_found", lambda x: (x["kind"] == kind) & (x["new"] != x["m"]))
        return F.when(F.col("_found").isNull(), 0).otherwise(F.size(replaced)).cast("long").alias(f"n_{kind}")

    return staged.select(*(text.alias("text") if c == "text" else F.col(c) for c in columns), *(map(counted, KINDS) if counts else []))
