"""Strict readings of JSON values, as importers need them: a number is not a string, absent is not null."""

from __future__ import annotations

import json
import math
import re
from datetime import UTC, datetime
from json.encoder import encode_basestring as _quoted

MISSING = object()
_INDEX = re.compile(r"(0|[1-9][0-9]{0,9})\Z")
_ISO = re.compile(r"(\d{4})(?:-(\d\d)(?:-(\d\d)(?:[T ](\d\d):(\d\d)(?::(\d\d)(?:\.(\d+))?)?\s*(Z|[+-]\d\d:?\d\d)?)?)?)?\Z")


def _refuse(name: str):
    raise ValueError(name)


_decode = json.JSONDecoder(parse_constant=_refuse).decode  # made once: importers parse every line


def parse_json(text: str):
    """The value of a JSON text; ValueError if it is none (NaN and Infinity are none)."""
    try:
        return _decode(text)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e


def try_parse(text):
    try:
        return parse_json(text) if isinstance(text, str) else MISSING
    except ValueError:
        return MISSING


def record(value) -> dict | None:
    return value if isinstance(value, dict) else None


def string(value) -> str | None:
    return value if isinstance(value, str) else None


def nonempty(value) -> str | None:
    return value if isinstance(value, str) and value else None


def is_number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def count(value) -> int | None:
    """A whole number from 0 on, or None."""
    return int(value) if is_number(value) and math.isfinite(value) and value >= 0 and value == int(value) else None


def rounded(value) -> int:
    """Halves go up."""
    return math.floor(value + 0.5)


def clean(text: str) -> str:
    """Lone surrogates cannot be stored; each becomes U+FFFD."""
    if text.isascii():
        return text
    try:
        text.encode("utf-8")
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def _number(x) -> str:
    if isinstance(x, int) and abs(x) <= 1 << 53:
        return str(x)
    f = float(x)
    if f == int(f) and abs(f) < 1e21:
        return str(int(f))
    mantissa, _, exponent = repr(f).partition("e")
    if not exponent:
        return mantissa
    e = int(exponent)
    if -7 < e < 0:  # plain notation down to a millionth
        digits = mantissa.lstrip("-").replace(".", "")
        return ("-" if f < 0 else "") + "0." + "0" * (-e - 1) + digits.rstrip("0")
    return f"{mantissa.removesuffix('.0')}e{'+' if e > 0 else '-'}{abs(e)}"


def dump(value) -> str:
    """Compact JSON: keys in order (array-like keys first, ascending), whole numbers without a point."""
    if isinstance(value, str):
        return _quoted(clean(value))
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if is_number(value):
        return _number(value)
    if isinstance(value, list):
        return "[" + ",".join(map(dump, value)) + "]"
    first = sorted([k for k in value if _INDEX.match(k) and int(k) < 4294967295], key=int)
    keys = [*first, *(k for k in value if not _INDEX.match(k) or int(k) >= 4294967295)] if first else value
    return "{" + ",".join([f"{_quoted(clean(k))}:{dump(value[k])}" for k in keys]) + "}"


def dump_record(value) -> str | None:
    return dump(value) if isinstance(value, dict) else None


def timestamp(value) -> int | None:
    """Epoch milliseconds of a positive number or an ISO string; None for anything else. Without an offset a time is
    UTC."""
    if is_number(value):
        return rounded(value) if math.isfinite(value) and value > 0 else None
    m = _ISO.match(value.strip()) if isinstance(value, str) else None
    if not m:
        return None
    y, mo, d, h, mi, s, frac, zone = m.groups()
    try:
        base = datetime(int(y), int(mo or 1), int(d or 1), tzinfo=UTC).timestamp()
    except (ValueError, OverflowError):
        return None
    h, mi, s = int(h or 0), int(mi or 0), int(s or 0)
    if h > 24 or mi > 59 or s > 59 or h == 24 and (mi or s):
        return None
    ms = round(base) * 1000 + (h * 3600 + mi * 60 + s) * 1000 + int(((frac or "") + "000")[:3])
    if zone and zone != "Z":
        ms -= (1 if zone[0] == "+" else -1) * (int(zone[1:3]) * 60 + int(zone[-2:])) * 60_000
    return ms if ms > 0 else None
