"""Format-preserving pseudonyms for personal data.

Numbers and dates that pass their format's check, and the names in e-mail addresses, are replaced by keyed Feistel
permutations within their format: a card number stays a card number with a right check digit, a date a
date in the same notation, a phone number keeps its shape. A permutation sends equal values to equal pseudonyms,
in every document, and different ones to different ones. All of it is SQL expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Dates are permuted within windows of DAYS = DAY_A x DAY_B days from 1900-01-01.
DAY_A, DAY_B = 250, 292
DAYS = DAY_A * DAY_B

# The formats, as Java regular expressions.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}[./-]\d{2}[./-]\d{4})(?![\d/-]|\.\d)"
IPV4 = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])"
#: A run of digit groups that may hold card numbers of 13 to 19 digits; it ends where another format begins.
RUN = rf"(?<![\d-])\d(?:(?:[ -](?!(?:{DATE})|(?:{IPV4})|(?:{SSN})|(?:{PHONE})))?\d){{12,398}}(?![\d-])"
#: How cards are printed: one group, or groups of 4, 4-6-5 and 4-6-4. Such readings of a run go before others.
PRINTED = r"\d{13,19}|\d{4}([ -])(?:\d{4}\1){2}\d{4}|\d{4}[ -]\d{6}[ -]\d{4,5}"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, DATE, IPV4, SSN, PHONE, RUN))
KINDS = ("email", "date", "ip", "ssn", "phone", "card")


def _kind(m: Column) -> Column:
    """The format a match has and passes the check of, else null; cards are found by ``_pieces``."""
    digits = F.regexp_replace(m, r"\D", "")
    octets = F.transform(F.split(m, r"\."), lambda x: x.try_cast("int"))
    return (
        F.when(m.contains("@"), F.lit("email"))
        .when(_day(m).isNotNull(), F.lit("date"))
        .when(m.rlike(rf"^(?:{IPV4})$"), F.when(F.forall(octets, lambda x: x <= 255), F.lit("ip")))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(~m.rlike(r"^(?:000|666|9)|-00-|-0000$"), F.lit("ssn")))
        .when(m.rlike(rf"^(?:{PHONE})$"), F.when(F.length(digits).between(7, 15), F.lit("phone")))
    )


def _pieces(m: Column) -> Column:
    """A match as an array of (m, kind) that make it up: itself, or for a run of digit groups its cards and what is between.

    Cards are the readings from group to group with 13 to 19 digits that pass the Luhn check; where they overlap, printed
    forms go first, then the leftmost, then the longest.
    """
    whole = F.array(F.struct(m.alias("m"), _kind(m).alias("kind")))
    groups = F.regexp_extract_all(m, F.lit(r"\d+[ -]?"), F.lit(0))
    cards = F.transform(F.array(groups), _cards)[0]
    none = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<m:string,kind:string>>").alias("out"))

    def put(a: Column, c: Column) -> Column:
        gap = F.struct(F.substring(m, a["at"], c["at"] - a["at"]).alias("m"), F.lit(None).cast("string").alias("kind"))
        card = F.struct(c["m"].alias("m"), F.lit("card").alias("kind"))
        return F.struct((c["at"] + F.length(c["m"])).alias("at"), F.concat(a["out"], F.array(gap, card)).alias("out"))

    def rest(a: Column) -> Column:
        return F.concat(a["out"], F.array(F.struct(F.substring(m, a["at"], F.length(m)).alias("m"), F.lit(None).cast("string").alias("kind"))))

    return F.when(m.rlike(r"^\d[\d -]{12,}$") & (F.length(F.translate(m, " -", "")) >= 13), F.aggregate(cards, none, put, rest)).otherwise(whole)


def _cards(groups: Column) -> Column:
    """The cards of a run, given as its groups with the separator after each: (at, m) in order of place."""

    def reading(i: Column, j: Column) -> Column:
        return F.struct(i.alias("i"), (-j).alias("j"), F.rtrim(F.array_join(F.slice(groups, i + 1, j - i + 1), ""), F.lit(" -")).alias("m"))

    def passes(c: Column) -> Column:
        digits = F.translate(c["m"], " -", "")
        return F.when(F.length(digits).between(13, 19), _luhn(digits) % 10 == 0).otherwise(False)

    def placed(c: Column) -> Column:
        at = F.length(F.array_join(F.slice(groups, F.lit(1), c["i"]), "")) + 1
        return F.struct((~c["m"].rlike(rf"^(?:{PRINTED})$")).alias("odd"), c["i"], c["j"], at.alias("at"), c["m"])

    def free(taken: Column, c: Column) -> Column:
        meets = F.exists(taken, lambda t: (c["at"] < t["at"] + F.length(t["m"])) & (t["at"] < c["at"] + F.length(c["m"])))
        return F.when(meets, taken).otherwise(F.concat(taken, F.array(F.struct(c["at"].alias("at"), c["m"].alias("m")))))

    last = F.size(groups) - 1
    every = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.transform(F.sequence(i, F.least(i + 18, last)), lambda j: reading(i, j))))
    best = F.array_sort(F.transform(F.filter(every, passes), placed))
    return F.array_sort(F.aggregate(best, F.array().cast("array<struct<at:int,m:string>>"), free))


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string whose last digit is the check digit."""
    each = F.split(F.reverse(digits), "(?<=.)(?=.)")

    def part(x: Column, i: Column) -> Column:
        d = x.try_cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(each, part), F.lit(0), lambda a, x: a + x)


def _day(m: Column) -> Column:
    """The date that a match in one of the date notations names; null where there is no such day."""
    iso = F.when(m.rlike(r"^\d{4}-\d{2}-\d{2}$"), m)
    dmy = F.when(m.rlike(r"^\d{2}[./-]\d{2}[./-]\d{4}$"), F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)))
    return F.coalesce(iso, dmy).try_cast("date")


def _prf(key: str, kind: str, round_: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), round_.cast("string"), half.cast("string")).cast("binary"), 256)


def _number(hex_: Column) -> Column:
    return F.conv(F.substring(hex_, 1, 12), 16, 10).cast("long")


def permute_number(value: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. a*b-1: halves in Z_a and Z_b take turns in being shifted by the other's hash."""
    start = F.struct(F.floor(value / F.lit(b)).cast("long").alias("l"), F.pmod(value, F.lit(b)).cast("long").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        left = F.pmod(s["l"] + _number(_prf(key, kind + "l", i, s["r"])), F.lit(a))
        mid = F.struct(left.cast("long").alias("l"), s["r"].alias("r"))
        return F.transform(F.array(mid), lambda t: F.struct(t["l"].alias("l"), F.pmod(t["r"] + _number(_prf(key, kind + "r", i, t["l"])), F.lit(b)).cast("long").alias("r")))[0]

    out = F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, turn)
    return out["l"] * F.lit(b) + out["r"]


def _shifted(half: Column, stream: Column) -> Column:
    """Each digit and letter of ``half`` moved within its class by the hex ``stream``."""
    chars = F.filter(F.split(half, ""), lambda c: c != "")

    def move(c: Column, i: Column) -> Column:
        k = F.conv(F.substring(stream, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        code = F.ascii(c)

        def within(first: str, size: int) -> Column:
            return F.chr((code - ord(first) + k) % size + ord(first))

        return F.when(c.between("0", "9"), within("0", 10)).when(c.between("a", "z"), within("a", 26)).when(c.between("A", "Z"), within("A", 26)).otherwise(c)

    return F.array_join(F.transform(chars, move), "")


def permute_text(value: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings of one shape: digits stay digits, letters letters, the rest stays."""
    n = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), n).alias("l"), F.substring(value, n + 1, F.length(value)).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        mid = F.struct(_shifted(s["l"], _prf(key, kind + "l", i, s["r"])).alias("l"), s["r"].alias("r"))
        return F.transform(F.array(mid), lambda t: F.struct(t["l"].alias("l"), _shifted(t["r"], _prf(key, kind + "r", i, t["l"])).alias("r")))[0]

    out = F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, turn)
    return F.concat(out["l"], out["r"])


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    gaps = F.split(shape, r"\d")
    each = F.transform(gaps, lambda g, i: F.concat(g, F.substring(digits, i + 1, F.lit(1))))
    return F.array_join(each, "")


def _pseudonym(m: Column, kind: Column, key: str) -> Column:
    digits = F.regexp_replace(m, r"\D", "")
    name = F.regexp_extract(m, "^([^@]+)@", 1)
    email = F.concat(permute_text(name, key, "email"), F.substring(m, F.length(name) + 1, F.length(m)))

    days = F.date_diff(_day(m), F.lit("1900-01-01").cast("date")).cast("long")
    window = F.floor(days / F.lit(DAYS)).cast("long")
    moved = F.date_add(F.lit("1900-01-01").cast("date"), (window * DAYS + permute_number(F.pmod(days, F.lit(DAYS)), DAY_A, DAY_B, key, "date")).cast("int"))
    day_first = F.concat(F.date_format(moved, "dd"), F.substring(m, 3, 1), F.date_format(moved, "MM"), F.substring(m, 6, 1), F.date_format(moved, "yyyy"))
    date = F.when(m.rlike(r"^\d{4}-"), F.date_format(moved, "yyyy-MM-dd")).otherwise(day_first)

    octets = F.transform(F.split(m, r"\."), lambda x: x.try_cast("long"))
    packed = F.aggregate(octets, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    ip = F.array_join(F.transform(F.array(permute_number(packed, 1 << 16, 1 << 16, key, "ip")), lambda v: F.concat_ws(".", F.shiftright(v, 24), F.shiftright(v, 16).bitwiseAND(255), F.shiftright(v, 8).bitwiseAND(255), v.bitwiseAND(255))), "")

    code = F.length(F.regexp_replace(F.regexp_extract(m, r"^\+(\d{1,3})[ .(-]", 1), r"\D", ""))
    phone = _refill(m, F.concat(F.substring(digits, F.lit(1), code), permute_text(F.substring(digits, code + 1, F.length(digits)), key, "phone")))

    # The area number of an SSN stays in 001 .. 665, the group in 01 .. 99, the serial in 0001 .. 9999.
    area, serial = F.substring(digits, 1, 3).cast("long"), F.substring(digits, 4, 6).cast("long")
    inner = (F.when(area > 666, area - 2).otherwise(area - 1)) * (99 * 9999) + (F.floor(serial / 10_000).cast("long") - 1) * 9999 + F.pmod(serial, F.lit(10_000)) - 1
    ssn = F.array_join(F.transform(F.array(permute_number(inner, 898 * 99, 9999, key, "ssn")), _ssn_text), "")

    body = permute_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    card = _refill(m, F.array_join(F.transform(F.array(body), lambda b: F.concat(b, F.pmod(-_luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string"))), ""))
    return F.when(kind == "email", email).when(kind == "date", date).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "ssn", ssn).when(kind == "card", card).otherwise(m)


def _ssn_text(v: Column) -> Column:
    area = F.floor(v / F.lit(99 * 9999)).cast("long") + 1
    area = F.when(area >= 666, area + 1).otherwise(area)
    group = F.pmod(F.floor(v / F.lit(9999)).cast("long"), F.lit(99)) + 1
    return F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad(group.cast("string"), 2, "0"), F.lpad((F.pmod(v, F.lit(9999)) + 1).cast("string"), 4, "0"))


def _of(kind: str):
    return lambda x: x["kind"].eqNullSafe(kind)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with personal data in text replaced, and n_pii and n_<kind> (email, date, ip, ssn, phone, card).

    A value that looks like a format but fails its check (Luhn, day of the calendar, octets, SSN areas)
    stays. Cards are looked for in runs of up to 399 digits; longer runs are read in parts. A null text stays null, with counts 0; an empty one stays empty. Repeated rows get the same text; an
    empty table gives an empty result. Other columns stay; own columns of those names are replaced.
    """
    own = ["n_pii", *[f"n_{k}" for k in KINDS]]
    docs = docs.drop(*own)
    names = docs.columns
    likely = F.col("text").rlike(r"@|\d[ ).-]?\d[ ).-]?\d|\d\.\d")
    found = docs.select(*names, F.when(likely, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("_m"))
    found = found.select(*names, F.when(F.size("_m") > 0, F.transform("_m", _pieces)).alias("_m"))
    new = F.transform("_m", lambda ps: F.array_join(F.transform(ps, lambda x: _pseudonym(x["m"], x["kind"], key)), ""))
    found = found.select(*names, F.flatten("_m").alias("_m"), F.when(F.col("_m").isNotNull(), new).alias("_new"))
    joined = F.array_join(F.zip_with(F.split("text", ANY), "_new", lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")
    text = F.when(F.col("_new").isNotNull(), joined).otherwise(F.col("text"))
    counts = [F.coalesce(F.size(F.filter("_m", _of(k))), F.lit(0)).alias(f"n_{k}") for k in KINDS]
    total = F.coalesce(F.size(F.filter("_m", lambda x: x["kind"].isNotNull())), F.lit(0)).alias("n_pii")
    return found.select(*[text.alias(c) if c == "text" else F.col(c) for c in names], total, *counts)
