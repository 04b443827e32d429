"""Checksums of identifiers, native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digits(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: c.try_cast("int"))


def iban_mod97(iban: Column) -> Column:
    """Remainder of a bare IBAN; 1 if it is valid, null if a character is none of A-Z and 0-9."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        value = F.when(digit, c.try_cast("int")).when(c.rlike("^[A-Z]$"), F.ascii(c) - 55)
        return (acc * F.when(digit, 10).otherwise(100) + value) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def iban_check_digits(country: Column, account: Column) -> Column:
    return F.lpad((98 - iban_mod97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0")


def mod11_10_check(body: Column) -> Column:
    """Check digit of ISO 7064 MOD 11,10 for a text of digits."""

    def step(product: Column, digit: Column) -> Column:
        total = (product + digit) % 10
        return (F.when(total == 0, 10).otherwise(total) * 2) % 11

    product = F.aggregate(_digits(body), F.lit(10), step)
    return (11 - product) % 10


def mod11_10_valid(text: Column) -> Column:
    whole = text.rlike("^[0-9]{2,}$")
    return F.coalesce(whole & (mod11_10_check(F.regexp_replace(text, ".$", "")) == F.right(text, F.lit(1)).try_cast("int")), F.lit(False))


def luhn_valid(text: Column) -> Column:
    each = F.transform(_digits(F.reverse(text)), lambda d, i: d * F.when(i % 2 == 1, 2).otherwise(1))
    total = F.aggregate(each, F.lit(0), lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(x))
    return F.coalesce(text.rlike("^[0-9]{2,}$") & (total % 10 == 0), F.lit(False))
