"""Validators of matched values, as Column builders and as Python functions over bytes."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21,
    "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

#: Numbers that were printed in advertisements and belong to nobody.
VOID_SSN = ("078051120", "219099999")

MIN_SECRET_BYTES, MIN_SECRET_KINDS, MIN_SECRET_BITS = 32, 8, 3.5


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def prefix_between(d: Column, width: int, low: int, high: int) -> Column:
    """Whether the first ``width`` digits lie in a range; shorter texts don't."""
    return (F.length(d) >= width) & F.substring(d, 1, width).between(str(low).zfill(width), str(high).zfill(width))


def luhn(x: Column) -> Column:
    d = digits(x)
    return (d != "") & F.call_function("luhn_check", d)


def _network(d: Column) -> dict[str, Column]:
    return {
        "visa": d.startswith("4"),
        "mastercard": prefix_between(d, 2, 51, 55) | prefix_between(d, 4, 2221, 2720),
        "amex": prefix_between(d, 2, 34, 34) | prefix_between(d, 2, 37, 37),
        "discover": d.startswith("6011") | d.startswith("65") | prefix_between(d, 3, 644, 649),
    }


def iin_prefix(x: Column) -> Column:
    n = _network(digits(x))
    return n["visa"] | n["mastercard"] | n["amex"] | n["discover"]


def length_per_network(x: Column) -> Column:
    d = digits(x)
    n, size = _network(d), F.length(d)
    return F.when(n["amex"], size == 15).when(n["visa"], size.isin(13, 16, 19)).when(n["mastercard"], size == 16).when(n["discover"], size.isin(16, 19)).otherwise(False)


def normal_iban(x: Column) -> Column:
    return F.upper(F.regexp_replace(x, "[\\t\\n\\x0B\\f\\r \\x85\\xA0]", ""))


def iban_country_length(x: Column) -> Column:
    n = normal_iban(x)
    table = F.create_map(*(F.lit(v) for kv in IBAN_LENGTHS.items() for v in kv))
    return (F.length(n) >= 4) & F.coalesce(F.try_element_at(table, F.substring(n, 1, 2)) == F.length(n), F.lit(False))


def iban_mod97(x: Column) -> Column:
    n = normal_iban(x)
    turned = F.concat(F.substr(n, F.lit(5)), F.substring(n, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("^[0-9]$"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + letter) % 97)

    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    return (F.length(n) >= 4) & n.rlike("^[0-9A-Z]+$") & (F.aggregate(chars, F.lit(0), step) == 1)


def ssn_range(x: Column) -> Column:
    d = digits(x)
    area, group, serial = F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 4)
    return (F.length(d) == 9) & ~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000") & ~d.isin(*VOID_SSN)


def entropy(x: Column) -> Column:
    """Enough bytes, enough different characters, and enough bits a character. x has one character a
    byte; characters are counted as text."""
    text = F.decode(F.encode(x, "ISO-8859-1"), "UTF-8")
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    kinds, n = F.array_distinct(chars), F.size(chars).cast("double")
    counts = F.transform(kinds, lambda k: F.size(F.filter(chars, lambda c: c == k)).cast("double"))
    bits = F.aggregate(counts, F.lit(0.0), lambda a, c: a - c / n * F.log2(c / n))
    return (F.length(x) >= MIN_SECRET_BYTES) & (F.size(kinds) >= MIN_SECRET_KINDS) & (bits >= MIN_SECRET_BITS)


COLUMNS: dict[str, Callable[[Column], Column]] = {
    "luhn": luhn, "iin_prefix": iin_prefix, "length_per_network": length_per_network, "iban_country_length": iban_country_length,
    "iban_mod97": iban_mod97, "ssn_range": ssn_range, "entropy": entropy,
}


def all_hold(names: tuple[str, ...], x: Column) -> Column:
    """All validators hold; an unknown name never does."""
    out = F.lit(True)
    for name in names:
        out = out & (COLUMNS[name](x) if name in COLUMNS else F.lit(False))
    return out


# --- the same over bytes --------------------------------------------------------------------------


_NO_DIGITS = bytes(b for b in range(256) if not 48 <= b <= 57)
#: Value of a digit, and the sum of the digits of its double, by its byte.
_ONCE = bytes(b - 48 if 48 <= b <= 57 else 0 for b in range(256))
_TWICE = bytes(sum(divmod(2 * d, 10)) for d in _ONCE)


def _digits(v: bytes) -> str:
    return v.translate(None, _NO_DIGITS).decode()


def _luhn(v: bytes) -> bool:
    d = v.translate(None, _NO_DIGITS)
    return bool(d) and (sum(d[-1::-2].translate(_ONCE)) + sum(d[-2::-2].translate(_TWICE))) % 10 == 0


def _networks(d: str) -> set[str]:
    def within(width: int, low: int, high: int) -> bool:
        return len(d) >= width and low <= int(d[:width]) <= high

    found = {"visa"} if d[:1] == "4" else set()
    found |= {"mastercard"} if within(2, 51, 55) or within(4, 2221, 2720) else set()
    found |= {"amex"} if d[:2] in ("34", "37") else set()
    return found | ({"discover"} if d[:4] == "6011" or d[:2] == "65" or within(3, 644, 649) else set())


_SIZES = {"amex": (15,), "visa": (13, 16, 19), "mastercard": (16,), "discover": (16, 19)}


def _iban(v: bytes) -> str:
    return "".join(v.decode("utf-8", "replace").split()).upper()


def _mod97(v: bytes) -> bool:
    n = _iban(v)
    if len(n) < 4 or any(not ("0" <= c <= "9" or "A" <= c <= "Z") for c in n):
        return False
    return int("".join(str(int(c, 36)) for c in n[4:] + n[:4])) % 97 == 1


def _ssn(v: bytes) -> bool:
    d = _digits(v)
    return len(d) == 9 and d[:3] not in ("000", "666") and d[:3] < "900" and d[3:5] != "00" and d[5:] != "0000" and d not in VOID_SSN


def _entropy(v: bytes) -> bool:
    counts = Counter(v.decode("utf-8", "replace"))
    n = sum(counts.values())
    bits = 0.0
    for c in counts.values():
        bits -= c / n * math.log2(c / n)
    return len(v) >= MIN_SECRET_BYTES and len(counts) >= MIN_SECRET_KINDS and bits >= MIN_SECRET_BITS


BYTES: dict[str, Callable[[bytes], bool]] = {
    "luhn": _luhn, "iin_prefix": lambda v: bool(_networks(_digits(v))), "length_per_network": lambda v: any(len(_digits(v)) in _SIZES[k] for k in _networks(_digits(v))),
    "iban_country_length": lambda v: len(_iban(v)) >= 4 and IBAN_LENGTHS.get(_iban(v)[:2]) == len(_iban(v)), "iban_mod97": _mod97, "ssn_range": _ssn, "entropy": _entropy,
}


def bytes_hold(names: tuple[str, ...], value: bytes) -> bool:
    return all(name in BYTES and BYTES[name](value) for name in names)
