"""Format-preserving pseudonyms for personal data (native).

Values are found by one pattern, validated by kind, and replaced by a keyed
permutation of their own format, so that equal values stay linked across
documents and the result is again valid:

* card numbers (Luhn): all digits but the last permuted, check digit renewed;
* IBANs (mod 97): account part permuted by character class, check digits renewed;
* IPv4 addresses and social security numbers: permuted among the valid ones;
* dates (day, month and year of a real day): permuted among the days of 200 years;
* e-mail addresses and phone numbers: characters permuted by character class, with
  the top-level domain or the country code left.

Each permutation is a Feistel network: two halves, a keyed round function from
SHA-2, addition modulo the size of the half, four rounds.  Halves of different
size (mixed radix) fit any domain that is a product, so no value is walked twice.

The key is the caller's: who has it can undo every pseudonym, so it has no default.

Cases: null text stays null; text without values stays as it is, and nothing
outside values changes; invalid values stay; repeated rows are treated each;
only ``text`` changes, and columns of the caller stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import MARK, OTHER, pieces

# What each kind looks like.
EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
#: Characters of an IBAN by country (the registry of SWIFT); a match ends there, whatever follows.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _bounded(length: int) -> str:
    groups, rest = divmod(length - 4, 4)
    return rf"(?:{LENGTHS[length].replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else "")


#: Countries that the table doesn't have, and other lengths.
OTHER_IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
IBAN = "|".join([*map(_bounded, LENGTHS), OTHER_IBAN])
DATES = {
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}": "yyyy-MM-dd",
    r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}": "dd.MM.yyyy",
    r"[0-9]{2}/[0-9]{2}/[0-9]{4}": "MM/dd/yyyy",
}
IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
CARD = r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})"
PHONE = r"(?:\+[0-9]{1,3}[ -]?)?\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|\+[0-9]{1,3}(?:[ -]?[0-9]{2,4}){3,5}|[0-9]{3}-[0-9]{3}-[0-9]{4}"
KINDS = ("email", "iban", "date", "ip", "ssn", "card", "phone")
#: No letter or digit follows a value, but the time may follow a date.
END = rf"(?:(?![A-Za-z0-9@])|(?<=[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})(?=T[0-9]{{2}}))"
ANY = rf"(?<![A-Za-z0-9@])(?:{EMAIL}|{IBAN}|{'|'.join(DATES)}|{IP}|{SSN}|{CARD}|{PHONE}){END}"

ROUNDS = 4
#: Days of a block within which dates are permuted: 292 * 250, just under 200 years.
DAYS = (292, 250)


def _number(key: str, tag: str, turn: Column, half: Column) -> Column:
    """The round function as a long of 60 bits."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), turn.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def permuted_pair(left: Column, right: Column, a: int, b: int, key: str, tag: str) -> Column:
    """A keyed permutation of the pairs (left, right) with left < a and right < b, as a struct."""

    def step(acc: Column, turn: Column) -> Column:
        new = F.pmod(acc["l"] + _number(key, tag + "l", turn, acc["r"]), F.lit(a))
        return F.struct(new.alias("l"), F.pmod(acc["r"] + _number(key, tag + "r", turn, new), F.lit(b)).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _shifted(c: Column, by: Column) -> Column:
    out = c
    for low, high in (("0", "9"), ("a", "z"), ("A", "Z")):
        n = ord(high) - ord(low) + 1
        moved = F.char(F.lit(ord(low)) + F.pmod(F.ascii(c) - ord(low) + by, F.lit(n)))
        out = F.when(c.between(low, high), moved).otherwise(out)
    return out


def permuted_text(value: Column, key: str, tag: str) -> Column:
    """A keyed permutation of the texts with the same character classes at the same places."""
    chars = F.split(value, "")
    half = F.floor(F.size(chars) / 2).cast("int")

    def step(acc: Column, turn: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), turn.cast("string"), F.array_join(acc["r"], "")), 512)
        shift = lambda i: F.conv(F.substring(digest, (i % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        return F.struct(acc["r"].alias("l"), F.transform(acc["l"], lambda c, i: _shifted(c, shift(i))).alias("r"))

    start = F.struct(F.slice(chars, 1, half).alias("l"), F.slice(chars, half + 1, F.size(chars) - half).alias("r"))
    done = lambda acc: F.concat(F.array_join(acc["l"], ""), F.array_join(acc["r"], ""))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, done)


def _luhn_sum(digits: Column, double_first: bool) -> Column:
    """Luhn sum from the right; ``double_first``: the last digit counts twice, as without a check digit."""
    odd = 0 if double_first else 1
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: c.cast("int") * F.when(i % 2 == odd, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(x))


def luhn_ok(digits: Column) -> Column:
    return _luhn_sum(digits, False) % 10 == 0


def mod97(text: Column) -> Column:
    """Remainder of an IBAN's rearranged text, letters as two digits."""
    return F.aggregate(F.split(text, ""), F.lit(0), lambda acc, c: (acc * F.when(c.between("0", "9"), 10).otherwise(100) + F.coalesce(F.when(c.between("0", "9"), c.try_cast("int")), F.ascii(c) - 55)) % 97)


def _full(pattern: str) -> str:
    return f"^(?:{pattern})$"


def _day(value: Column) -> Column:
    found = F.lit(None).cast("date")
    for pattern, fmt in DATES.items():
        found = F.when(value.rlike(_full(pattern)), F.try_to_timestamp(value, F.lit(fmt)).cast("date")).otherwise(found)
    return found


def kind_of(value: Column) -> Column:
    """The kind of a matched value, null if it isn't valid."""
    bare = F.replace(value, F.lit(" "), F.lit(""))
    octets = F.split(value, r"\.")
    area, group, serial = F.substring(value, 1, 3), F.substring(value, 5, 2), F.substring(value, 8, 4)
    return (
        F.when(value.rlike(_full(EMAIL)), "email")
        .when(value.rlike(_full(IBAN)), F.when(mod97(F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4))) == 1, "iban"))
        .when(value.rlike(_full("|".join(DATES))), F.when(_day(value).isNotNull(), "date"))
        .when(value.rlike(_full(IP)), F.when(F.forall(octets, lambda o: o.try_cast("int") <= 255), "ip"))
        .when(value.rlike(_full(SSN)), F.when((area != "000") & (area != "666") & (area < "900") & (group != "00") & (serial != "0000"), "ssn"))
        .when(value.rlike(_full(CARD)), F.when(luhn_ok(F.regexp_replace(value, "[ -]", "")), "card"))
        .when(value.rlike(_full(PHONE)), "phone")
    )


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a valid value of a kind."""
    bare = F.replace(value, F.lit(" "), F.lit(""))

    def each(x: Column, then) -> Column:  # noqa: ANN001  names a value once, so that it is computed once
        return F.get(F.transform(F.array(x), then), F.lit(0))

    def card(body: Column) -> Column:
        check = (10 - _luhn_sum(body, True) % 10) % 10
        gap = F.regexp_extract(value, "([ -])", 1)
        whole = F.concat(body, check.cast("string"))
        short = F.concat(F.substring(whole, 1, 4), gap, F.substring(whole, 5, 6), gap, F.substring(whole, 11, 5))
        return F.when(gap == "", whole).when(F.length(whole) == 15, short).otherwise(F.concat(F.substring(whole, 1, 4), gap, F.substring(whole, 5, 4), gap, F.substring(whole, 9, 4), gap, F.substring(whole, 13, 4)))

    def iban(account: Column) -> Column:
        country = F.substring(bare, 1, 2)
        check = F.lpad((98 - mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
        whole = F.concat(country, check, account)
        return F.when(value == bare, whole).otherwise(F.rtrim(F.regexp_replace(whole, "(.{4})", "$1 ")))

    def date(day: Column) -> Column:
        n = F.unix_date(day).cast("long")
        size = DAYS[0] * DAYS[1]
        block = F.floor((n + 25567) / size)
        place = F.pmod(n + 25567, F.lit(size))
        new = each(permuted_pair(F.floor(place / DAYS[1]), place % DAYS[1], *DAYS, key, "date"), lambda x: F.date_from_unix_date((block * size + x["l"] * DAYS[1] + x["r"] - 25567).cast("int")))
        out = F.lit(None).cast("string")
        for pattern, fmt in DATES.items():
            out = F.when(value.rlike(_full(pattern)), F.date_format(new, fmt)).otherwise(out)
        return out

    octet = lambda i: F.element_at(F.split(value, r"\."), i).try_cast("int")
    ip = each(
        permuted_pair(octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), 65536, 65536, key, "ip"),
        lambda x: F.concat_ws(".", *[F.floor(x[h] / 256).cast("string") if hi else (x[h] % 256).cast("string") for h in ("l", "r") for hi in (True, False)]),
    )
    area = F.substring(value, 1, 3).try_cast("int")
    # Areas 1 to 899 without 666 as 0 to 897; groups and serials from 0.
    left = (area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + F.substring(value, 5, 2).try_cast("int") - 1
    new_area = lambda x: F.floor(x["l"] / 99) + 1 + F.when(F.floor(x["l"] / 99) + 1 >= 666, 1).otherwise(0)
    ssn = each(
        permuted_pair(left, F.substring(value, 8, 4).try_cast("int") - 1, 898 * 99, 9999, key, "ssn"),
        lambda x: F.concat_ws("-", F.lpad(new_area(x).cast("string"), 3, "0"), F.lpad((x["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((x["r"] + 1).cast("string"), 4, "0")),
    )
    tail = lambda p: F.regexp_extract(value, p, 1)
    return (
        F.when(kind == "email", F.concat(permuted_text(tail(r"^(.*)\.[^.]+$"), key, "email"), tail(r"(\.[^.]+)$")))
        .when(kind == "iban", each(permuted_text(F.substr(bare, F.lit(5)), key, "iban"), iban))
        .when(kind == "date", each(_day(value), date))
        .when(kind == "ip", ip)
        .when(kind == "ssn", ssn)
        .when(kind == "card", each(permuted_text(F.regexp_replace(F.regexp_replace(value, "[ -]", ""), "[0-9]$", ""), key, "card"), card))
        .when(kind == "phone", F.concat(tail(r"^((?:\+[0-9]{1,3})?[ -]?)"), permuted_text(F.regexp_replace(value, r"^(?:\+[0-9]{1,3})?[ -]?", ""), key, "phone")))
        .otherwise(value)
    )


def _escaped(text: Column) -> Column:
    """``text`` without ``MARK``; no pattern sees a letter or digit that was not there."""
    pair = F.replace(F.replace(text, F.lit(OTHER), F.lit(OTHER + "\x04")), F.lit(MARK), F.lit(OTHER + "\x03"))
    return F.when(text.rlike(f"[{MARK}{OTHER}]"), pair).otherwise(text)


def _restored(text: Column) -> Column:
    pair = F.replace(F.replace(text, F.lit(OTHER + "\x03"), F.lit(MARK)), F.lit(OTHER + "\x04"), F.lit(OTHER))
    return F.when(F.contains(text, F.lit(OTHER)), pair).otherwise(text)


def with_pseudonyms(docs: DataFrame, prefix: str, key: str, text: str = "text") -> DataFrame:
    """Adds prefix + text (values replaced) and prefix + n_<kind> for each kind."""
    if not key:
        raise ValueError("pseudonyms need a key")
    raw = _escaped(F.coalesce(F.col(text), F.lit("")))
    cut, valued = prefix + "cut", prefix + "valued"
    df = docs.withColumn(cut, F.when(raw.rlike(ANY), pieces(raw, ANY)))
    named = F.transform(cut, lambda p, i: F.struct(p.alias("p"), F.when(i % 2 == 1, kind_of(p)).alias("kind")))
    df = df.withColumn(valued, named)
    replaced = F.array_join(F.transform(valued, lambda x: F.when(x["kind"].isNull(), x["p"]).otherwise(pseudonym(x["p"], x["kind"], key))), "")
    replaced = _restored(replaced)
    of = lambda k: F.coalesce(F.size(F.filter(valued, lambda x: x["kind"] == k)), F.lit(0))
    counts = {f"{prefix}n_{k}": F.greatest(of(k), F.lit(0)).cast("long") for k in KINDS}
    return df.withColumns({prefix + "text": F.when(F.col(cut).isNull(), F.col(text)).otherwise(replaced)} | counts).drop(cut, valued)


def pseudonyms_query(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with pseudonyms, and the number of values of each kind."""
    out = with_pseudonyms(docs.select("doc_id", "text"), "ps_", key)
    return out.select("doc_id", F.col("ps_text").alias("text"), *[F.col(f"ps_n_{k}").alias(f"n_{k}") for k in KINDS])
