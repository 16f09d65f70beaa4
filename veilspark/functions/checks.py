"""Checksums, entropy and other tests of values, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Literals that are no secrets.
NO_SECRETS = (
    "null", "none", "nil", "true", "false", "undefined", "empty",
    "changeme", "change_me", "change-me", "password", "passwd", "secret", "token",
    "your_password", "yourpassword", "your-password", "placeholder",
)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _digit(value: Column, i: int) -> Column:
    return F.substring(value, i, 1).try_cast("int")


def national_id(value: Column) -> Column:
    """Eleven digits, the first not 0, whose last two are check digits."""
    d = digits(value)
    odd = sum((_digit(d, i) for i in (3, 5, 7, 9)), _digit(d, 1))
    even = sum((_digit(d, i) for i in (4, 6, 8)), _digit(d, 2))
    tenth = F.pmod(odd * 7 - even, F.lit(10)) == _digit(d, 10)
    last = F.pmod(odd + even + _digit(d, 10), F.lit(10)) == _digit(d, 11)
    return F.coalesce((F.length(d) == 11) & ~d.startswith("0") & tenth & last, F.lit(False))


def luhn(value: Column) -> Column:
    """Whether the digits of a card number add up."""
    d = F.reverse(digits(value))
    place = F.sequence(F.lit(1), F.length(d))
    doubled = F.transform(place, lambda i: F.substring(d, i, F.lit(1)).try_cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return F.coalesce((F.length(d) >= 12) & (total % 10 == 0), F.lit(False))


def iban(value: Column) -> Column:
    """Whether an account number gives 1 modulo 97 (letters count from 10, the first four signs move to the end)."""
    v = F.upper(F.regexp_replace(value, "[^A-Za-z0-9]", ""))
    moved = F.concat(F.substring(v, 5, 1000), F.substring(v, 1, 4))
    rest = F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda a, c: F.when(c == "", a).when(c.rlike("^[0-9]$"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return F.coalesce((F.length(v) >= 15) & (rest == 1), F.lit(False))


def entropy(value: Column) -> Column:
    """Shannon entropy in bits for each character; 0 for the empty string."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    terms = F.transform(F.array_sort(F.array_distinct(chars)), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.when(F.length(value) == 0, 0.0).otherwise(F.aggregate(terms, F.lit(0.0), lambda a, p: a - p * F.log2(p)))


def secret_value(value: Column) -> Column:
    """Whether an assigned value can be a secret: no known literal, no repeated sign, no reference or format, and, unless quoted, no bare identifier."""
    quoted = (F.length(value) >= 2) & value.rlike("""(?s)^(?:".*"|'.*')$""")
    v = F.regexp_replace(F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value), r"^\s+|\s+$", "")
    literal = F.lower(v).isin(*NO_SECRETS)
    repeated = v.rlike(r"(?s)^(.)\1*$")
    # References (only names in capitals after a bare $), formats and colours, names in code.
    reference = v.rlike(r"^(?:\$\{|\$\(|\$[A-Z_][A-Z0-9_]*$|%[A-Za-z_][\w.]*%$|\{\{|#\{|<%)")
    form = v.rlike(r"^(?:\{[\w.]*\}|%(?:\([\w.]+\))?[sd]|<[\w-]+>|#[0-9A-Fa-f]{3,8})$")
    name = ~quoted & v.rlike("^[A-Za-z_]+$|^[a-z][a-z0-9]*(?:_[a-z0-9]+)+$")
    return F.coalesce((F.length(v) > 0) & ~literal & ~repeated & ~reference & ~form & ~name, F.lit(False))
