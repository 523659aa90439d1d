"""Format-preserving pseudonyms of personal data, in DataFrame functions alone.

Candidates are found by one pattern, validated (card numbers by the Luhn sum, bank numbers by the remainder of 97, dates by the
calendar, addresses by their octets, social security numbers by their areas) and permuted within their format by a keyed
Feistel network over Z_a x Z_b: l = (l + H(key, kind, round, r)) mod a and r = (r + H(key, kind, round, l)) mod b in turn,
where a * b is the format's domain. Dates walk the cycle until they are days of 1900-2099 again. Letters and digits of a mail
address's local part, and the body of a bank number, are shifted within their alphabets, half by half. Equal values so become
equal pseudonyms in every document, distinct ones distinct, and whatever is not valid stays as it is.

Where a grouped card or bank number fails its check at its longest, its shorter beginnings are tried, and the text behind the one that
holds, or behind its first group, is searched again, PASSES times.

Defined results: null text -> null, 0 found; text without valid candidates is unchanged; separators, and country codes of
telephone numbers, are kept; repeated rows are treated alike; an empty table gives no rows; other columns pass, but for
n_found, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
FIRST_DAY, DAYS = "1900-01-01", 73049  # the days of 1900-2099
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_B, _E = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: kind -> pattern, in the order in which they are tried at a place
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "ip": rf"(?<![\p{{L}}\p{{N}}_.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[\p{{L}}\p{{N}}_])",
    "phone": rf"(?<![\p{{L}}\p{{N}}_])(?:\+[0-9]{{1,3}}[ -]?)?\([0-9]{{3}}\) ?[0-9]{{3}}[ -][0-9]{{4}}{_E}|(?<![\p{{L}}\p{{N}}_])\+[0-9]{{1,3}}[ -][0-9]{{3}}[ -][0-9]{{3}}[ -][0-9]{{4}}{_E}|(?<![\p{{L}}\p{{N}}_])\+[0-9]{{1,3}}(?:[ -][0-9]{{1,4}}){{3,6}}{_E}|{_B}[2-9][0-9]{{2}}(?<ph>[.-])[0-9]{{3}}\k<ph>[0-9]{{4}}{_E}",
    "ssn": rf"{_B}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_E}",
    "date": rf"{_B}(?:19|20)[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}(?:{_E}|(?=T[0-9]{{2}}:))|{_B}[0-9]{{2}}(?<dm>[./])[0-9]{{2}}\k<dm>(?:19|20)[0-9]{{2}}{_E}",
    "iban": rf"{_B}[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_E}",
    "card": rf"{_B}(?:[0-9]{{13,19}}|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}}|[0-9]{{4}}(?:[ -][0-9]{{4}}){{2,3}}(?:[ -][0-9]{{1,3}})?){_E}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
LATIN_LOWER, LATIN_UPPER = ("".join(chr(c) for c in range(a, b) if c not in (0xD7, 0xF7)) for a, b in ((0xDF, 0x100), (0xC0, 0xDF)))
#: Marks of what later passes leave alone: OPEN, a kind (v: a pseudonym, w: text as it was, a and b: the marks themselves), text, CLOSE.
OPEN, CLOSE = "\ue000", "\ue001"
MARKED = f"{OPEN}[^{CLOSE}]*{CLOSE}"
#: Further passes over a text in which a card or bank number's longest form is not valid.
PASSES = 3


def _hash(key: str, kind: str, i: Column, value: Column) -> Column:
    """A keyed 48-bit number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), value.cast("string")), 256), 1, 12), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """struct(l, r): the permutation of Z_a x Z_b."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(s["l"] + _hash(key, kind, i, s["r"]), a)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(F.pmod(s["r"] + _hash(key, kind, i, s["l"]), b)).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A digit string (2 to 18 digits) to another of its length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    s = feistel(F.substr(digits, F.lit(1), half), F.substr(digits, half + 1, n - half), _power(half), _power(n - half), key, kind)
    return F.transform(F.array(s), lambda x: F.concat(F.lpad(x["l"].cast("string"), half, "0"), F.lpad(x["r"].cast("string"), n - half, "0")))[0]


def _only_digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _refill(v: Column, digits: Column) -> Column:
    """v with its digits replaced in order."""
    start = F.struct(F.lit("").alias("o"), F.lit(1).alias("p"))
    return F.aggregate(
        F.split(v, ""), start,
        lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s["o"], F.substr(digits, s["p"], F.lit(1))).alias("o"), (s["p"] + 1).alias("p"))).otherwise(F.struct(F.concat(s["o"], c).alias("o"), s["p"].alias("p"))),
        lambda s: s["o"],
    )


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string whose last digit counts once."""
    places = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    values = F.transform(places, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def _card(v: Column, key: str) -> Column:
    old = _only_digits(v)
    body = permute_digits(F.substr(old, F.lit(1), F.length(old) - 1), key, "card")
    new = F.transform(F.array(body), lambda b: F.concat(b, F.pmod(-luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))[0]
    return F.when(luhn_sum(old) % 10 == 0, F.transform(F.array(new), lambda n: _refill(v, n))[0])


def _phone(v: Column, key: str) -> Column:
    old = _only_digits(v)
    # the country code stays, and with a national number of ten digits or more all but the last ten
    code = F.length(F.regexp_extract(v, r"^\+([0-9]{1,3})[ -]", 1))
    kept = F.greatest(F.length(old) - 10, code)
    new = F.concat(F.substr(old, F.lit(1), kept), permute_digits(F.substr(old, kept + 1, F.length(old) - kept), key, "phone"))
    return F.when((F.length(old) - code).between(7, 14), F.transform(F.array(new), lambda n: _refill(v, n))[0])


def _ip(v: Column, key: str) -> Column:
    o = F.transform(F.split(v, "\\."), lambda x: x.cast("long"))
    s = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ip")
    part = lambda x: F.concat(F.floor(x / 256).cast("string"), F.lit("."), F.pmod(x, F.lit(256)).cast("string"))
    return F.transform(F.array(s), lambda x: F.concat(part(x["l"]), F.lit("."), part(x["r"])))[0]


def _ssn(v: Column, key: str) -> Column:
    area, group, serial = (F.substring(v, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)  # 898 areas
    s = feistel(place * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")

    def shape(x: Column) -> Column:
        p = F.floor(x["l"] / 99)
        number = F.when(p + 1 >= 666, p + 2).otherwise(p + 1)
        return F.concat_ws("-", F.lpad(number.cast("string"), 3, "0"), F.lpad((F.pmod(x["l"], F.lit(99)) + 1).cast("string"), 2, "0"), F.lpad((x["r"] + 1).cast("string"), 4, "0"))

    return F.when(valid, F.transform(F.array(s), shape)[0])


def _date(v: Column, key: str) -> Column:
    iso = v.rlike("^[0-9]{4}-")
    mark = F.substring(v, 3, 1)
    dmy = F.concat_ws("-", F.substring(v, 7, 4), F.substring(v, 4, 2), F.substring(v, 1, 2))
    day = F.datediff(F.try_to_timestamp(F.when(iso, v).otherwise(dmy), F.lit("yyyy-MM-dd")).cast("date"), F.lit(FIRST_DAY).cast("date"))
    side = 271  # 271 * 271 is the least square from DAYS on

    def walk(x: Column, _: Column) -> Column:
        again = feistel(F.floor(x["d"] / side), F.pmod(x["d"], F.lit(side)), F.lit(side), F.lit(side), key, "date")
        moved = F.transform(F.array(again), lambda y: y["l"] * side + y["r"])[0]
        return F.when(x["done"], x).otherwise(F.transform(F.array(moved), lambda m: F.struct(m.alias("d"), (m < DAYS).alias("done")))[0])

    new = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.struct(day.cast("long").alias("d"), F.lit(False).alias("done")), walk, lambda x: F.date_add(F.lit(FIRST_DAY).cast("date"), x["d"].cast("int")))
    shown = F.transform(F.array(new), lambda d: F.when(iso, F.date_format(d, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(d, "dd"), mark, F.date_format(d, "MM"), mark, F.date_format(d, "yyyy"))))[0]
    return F.when(day.between(0, DAYS - 1), shown)


def _shift(part: Column, by: Column, key: str, kind: str, i: Column) -> Column:
    """Each letter and digit moved within its alphabet, by a keyed stream of the other part."""
    stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), by), 256)

    def one(c: Column, j: Column, hexes: Column) -> Column:
        s = F.conv(F.substr(hexes, (F.pmod(j, F.lit(31)) * 2 + 1).cast("int"), F.lit(3)), 16, 10).cast("int")
        out = c
        for alphabet in (LOWER, UPPER, DIGITS, LATIN_LOWER, LATIN_UPPER):
            at = F.instr(F.lit(alphabet), c) - 1
            out = F.when((at >= 0) & (c != ""), F.substr(F.lit(alphabet), (F.pmod(at + s, F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))).otherwise(out)
        return out

    return F.transform(F.array(stream), lambda h: F.array_join(F.transform(F.split(part, ""), lambda c, j: one(c, j, h)), ""))[0]


def permute_text(v: Column, key: str, kind: str) -> Column:
    half = F.floor(F.length(v) / 2).cast("int")
    start = F.struct(F.substr(v, F.lit(1), half).alias("l"), F.substr(v, half + 1, F.length(v) - half).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, _shift(s["l"], s["r"], key, kind, i)).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(_shift(s["r"], s["l"], key, kind, i)).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def _email(v: Column, key: str) -> Column:
    return F.concat(permute_text(F.substring_index(v, "@", 1), key, "email"), F.lit("@"), F.substring_index(v, "@", -1))


def _rest_97(text: Column) -> Column:
    """Remainder of 97 of a bank number's digits, letters counting 10 to 35."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda s, c: F.pmod(F.when(c.rlike("[0-9]"), s * 10 + F.when(c.rlike("[0-9]"), c).otherwise("0").cast("int")).otherwise(s * 100 + F.ascii(c) - 55), F.lit(97)))


def _iban(v: Column, key: str) -> Column:
    plain = F.replace(v, F.lit(" "), F.lit(""))
    country, body = F.substring(plain, 1, 2), F.substr(plain, F.lit(5), F.length(plain) - 4)
    moved = permute_text(body, key, "iban")
    new = F.transform(F.array(moved), lambda b: F.concat(country, F.lpad((98 - _rest_97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))[0]
    spaced = F.transform(F.array(new), lambda n: F.when(F.instr(v, " ") > 0, F.rtrim(F.regexp_replace(n, "(.{4})", "$1 "))).otherwise(n))[0]
    return F.when(_rest_97(F.concat(body, F.substring(plain, 1, 4))) == 1, spaced)


_PERMUTERS = {"email": _email, "ip": _ip, "phone": _phone, "ssn": _ssn, "date": _date, "iban": _iban, "card": _card}


def pseudonym(value: Column, key: str, kinds: tuple[str, ...] = tuple(PATTERNS)) -> Column:
    """A candidate's pseudonym; null if it is not valid."""
    out = F.lit(None).cast("string")
    for kind in reversed(kinds):
        out = F.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), _PERMUTERS[kind](value, key)).otherwise(out)
    return out


def _wrap(kind: str, text: Column) -> Column:
    return F.concat(F.lit(OPEN + kind), text, F.lit(CLOSE))


def _longest(v: Column, key: str) -> Column:
    """A candidate with its pseudonym. Where it is not valid, and in groups: with its longest valid beginning of whole groups (of 13 digits or
    more, or a bank number) replaced, or failing that its first group set aside. What is behind stays open for the next pass."""
    inner = F.when(v.rlike(GROUPED), F.filter(F.sequence(F.length(v), F.lit(2), F.lit(-1)), lambda i: F.substr(v, i, F.lit(1)).isin(" ", "-"))).otherwise(F.array().cast("array<int>"))
    part = lambda i: F.substr(v, F.lit(1), i - 1)
    long = F.filter(inner, lambda i: part(i).rlike("^[A-Z]") | (F.length(_only_digits(part(i))) >= 13))
    tried = F.transform(F.concat(F.array(F.length(v) + 1), long), lambda i: F.struct(i.alias("cut"), pseudonym(part(i), key).alias("new")))
    first = F.regexp_extract(v, "^[^ -]+", 0)
    aside = F.when(v.rlike(GROUPED), F.concat(_wrap("w", first), F.substr(v, F.length(first) + 1, F.length(v))))
    return F.transform(F.array(F.filter(tried, lambda t: t["new"].isNotNull())), lambda g: F.when(F.size(g) > 0, F.concat(_wrap("v", g[0]["new"]), F.substr(v, g[0]["cut"], F.length(v)))).otherwise(aside))[0]


#: A candidate in groups, whose shorter forms may be valid.
GROUPED = "^[A-Z0-9]{4,6}[ -]"


def _replaced(text: Column, pattern: str, found: Column, new: Column) -> Column:
    pieces = F.split(text, pattern, -1)
    return F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(new, i), F.get(found, i), F.lit("")))), "")


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with personal data in ``text`` replaced, and n_found: how many values were."""
    text, found, new, again = F.col("text"), F.col("__found"), F.col("__new"), F.col("__again")
    others = [c for c in docs.columns if c not in ("n_found", "text")]
    d = docs.drop("n_found").withColumn("__found", F.when(text.rlike("[0-9@]") & text.rlike(ANY), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    d = d.withColumn("__new", F.transform("__found", lambda v: pseudonym(v, key)))
    # the few texts with a grouped candidate that is not valid go on, with the marks that they hold set aside
    open_ = F.exists(F.arrays_zip(found.alias("f"), new.alias("n")), lambda x: x["n"].isNull() & x["f"].rlike(GROUPED))
    marked = F.regexp_replace(F.regexp_replace(text, f"{OPEN}|{CLOSE}", f"{OPEN}$0"), f"{OPEN}({OPEN}|{CLOSE})", f"{OPEN}m$1")
    marked = F.replace(F.replace(marked, F.lit(f"{OPEN}m{OPEN}"), F.lit(f"{OPEN}a{CLOSE}")), F.lit(f"{OPEN}m{CLOSE}"), F.lit(f"{OPEN}b{CLOSE}"))
    pattern = f"{MARKED}|{ANY}"

    def once_more(t: Column, _: Column) -> Column:
        new_of = lambda v: F.when(F.startswith(v, F.lit(OPEN)), v).otherwise(_longest(v, key))
        return F.transform(F.array(F.regexp_extract_all(t, F.lit(pattern), F.lit(0))), lambda f: _replaced(t, pattern, f, F.transform(f, new_of)))[0]

    d = d.withColumn("__again", F.when(open_, F.aggregate(F.sequence(F.lit(1), F.lit(PASSES)), marked, once_more)))
    values = F.size(F.regexp_extract_all(again, F.lit(f"{OPEN}v"), F.lit(0)))
    plain = F.regexp_replace(again, f"{OPEN}[vw]([^{CLOSE}]*){CLOSE}", "$1")
    plain = F.replace(F.replace(plain, F.lit(f"{OPEN}a{CLOSE}"), F.lit(OPEN)), F.lit(f"{OPEN}b{CLOSE}"), F.lit(CLOSE))
    count = F.size(F.filter("__new", lambda x: x.isNotNull()))
    out = d.withColumn("__text", F.when(again.isNotNull(), plain).when(F.exists("__new", lambda x: x.isNotNull()), _replaced(text, ANY, found, new)).otherwise(text))
    out = out.withColumn("n_found", F.coalesce(F.when(again.isNotNull(), values).otherwise(count), F.lit(0))).withColumn("text", F.col("__text"))
    return out.select(*[c for c in docs.columns if c in others or c == "text"], "n_found")
