"""Checks of number-like values as column expressions, and the same as SQL. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Digits of other scripts are digits: Arabic, Persian, Devanagari, Thai, full width.
_OTHER = "".join(chr(first + d) for d in range(10) for first in (0x660, 0x6F0, 0x966, 0xE50, 0xFF10))
_PLAIN = "".join(str(d) * 5 for d in range(10))


def _bare(v: Column) -> Column:
    return F.upper(F.translate(F.regexp_replace(v, r"(?U)\s", ""), _OTHER, _PLAIN))


def _digits(v: Column) -> Column:
    return F.translate(F.regexp_replace(v, r"(?U)[\s-]", ""), _OTHER, _PLAIN)


def luhn(v: Column) -> Column:
    """13 to 19 digits with a right Luhn check digit, blanks and hyphens aside."""
    d = _digits(v)
    ok = F.call_function("luhn_check", d)
    return d.rlike(r"^\d{13,19}$") & ok


def iban(v: Column) -> Column:
    """15 to 34 characters, two letters and two digits first, rest of division by 97 equal to 1."""
    s = _bare(v)
    turned = F.split(F.concat(F.substring(s, 5, 34), F.substring(s, 1, 4)), "")
    step = lambda n, c: F.when(c.rlike("[0-9]"), (n * 10 + F.ascii(c) - 48) % 97).otherwise((n * 100 + F.ascii(c) - 55) % 97)
    rest = F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), step)
    return s.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$") & (rest == 1)


def uk_iban(v: Column) -> Column:
    return _bare(v).startswith("GB") & (F.length(_bare(v)) == 22) & iban(v)


def nino(v: Column) -> Column:
    """Two letters, six digits, a letter A to D; the letters and their pairs that are never given out are refused."""
    s = _bare(v)
    return s.rlike(r"^[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\d{6}[A-D]$") & ~F.substring(s, 1, 2).isin("BG", "GB", "KN", "NK", "NT", "TN", "ZZ")


def nhs(v: Column) -> Column:
    """Ten digits; weights 10 to 2 over the first nine, 11 less the rest of division by 11 is the tenth (11 is 0, 10 never)."""
    d = _digits(v)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(9)), F.lit(0), lambda n, i: n + F.substring(d, i, F.lit(1)).try_cast("int") * (11 - i))
    return d.rlike(r"^\d{10}$") & ((11 - total % 11) % 11 == F.substring(d, 10, 1).try_cast("int")) & (11 - total % 11 != 10)


def lat_long(v: Column) -> Column:
    """Latitude within 90 and longitude within 180 degrees."""
    a, b = (F.trim(F.split_part(v, F.lit(","), F.lit(i))).try_cast("double") for i in (1, 2))
    return a.between(-90, 90) & b.between(-180, 180)


_FOLD = f"'{_OTHER}', '{_PLAIN}'"
_DIGITS = "translate(regexp_replace({v}, '[\\s\\pZ-]', '', 'g'), " + _FOLD + ")"
_BARE = "upper(translate(regexp_replace({v}, '[\\s\\pZ]', '', 'g'), " + _FOLD + "))"
_LETTERS = "string_split(substring(" + _BARE + ", 5, 34) || substring(" + _BARE + ", 1, 4), '')"
_IBAN = "(regexp_full_match(" + _BARE + ", '[A-Z]{{2}}\\d{{2}}[A-Z0-9]{{11,30}}') and list_reduce(list_transform(list_prepend('0', " + _LETTERS + "), lambda c: (case when c between '0' and '9' then ascii(c) - 48 else ascii(c) - 55 end)::bigint), lambda n, x: (case when x < 10 then n * 10 + x else n * 100 + x end) % 97) = 1)"
SQL = {
    "luhn": "(regexp_full_match(" + _DIGITS + ", '\\d{{13,19}}') and list_sum(list_transform(range(length(" + _DIGITS + ")), lambda i: (case when i % 2 = 1 then (case when substring(reverse(" + _DIGITS + "), (i + 1)::bigint, 1)::int * 2 > 9 then substring(reverse(" + _DIGITS + "), (i + 1)::bigint, 1)::int * 2 - 9 else substring(reverse(" + _DIGITS + "), (i + 1)::bigint, 1)::int * 2 end) else substring(reverse(" + _DIGITS + "), (i + 1)::bigint, 1)::int end))) % 10 = 0)",
    "iban": _IBAN,
    "uk_iban": "(" + _BARE + " like 'GB%' and length(" + _BARE + ") = 22 and " + _IBAN + ")",
    "nino": "(regexp_full_match(" + _BARE + ", '[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\\d{{6}}[A-D]') and substring(" + _BARE + ", 1, 2) not in ('BG','GB','KN','NK','NT','TN','ZZ'))",
    "nhs": "(regexp_full_match(" + _DIGITS + ", '\\d{{10}}') and (11 - list_sum(list_transform(range(1, 10), lambda i: substring(" + _DIGITS + ", i, 1)::int * (11 - i))) % 11) % 11 = substring(" + _DIGITS + ", 10, 1)::int and 11 - list_sum(list_transform(range(1, 10), lambda i: substring(" + _DIGITS + ", i, 1)::int * (11 - i))) % 11 <> 10)",
    "lat_long": "(try_cast(trim(split_part({v}, ',', 1)) as double) between -90 and 90 and try_cast(trim(split_part({v}, ',', 2)) as double) between -180 and 180)",
}
