"""Secrets in text: three fixed shapes, and strings that are news to a compressor.

The fixed shapes are regular expressions. Beyond them, a candidate string in a sensitive context (a word such as
"bearer" or "credential" shortly before or after it) is compressed after its surroundings by zstandard, primed with a
dictionary of common identifiers. Names, paths and words cost few marginal bytes, keys cost nearly all of theirs.
Strings without digits, or short ones, must cost more, and such as are made of words are no candidates.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import column_udf, without

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_HEX_MAP = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))

SENSITIVE = ("password", "passwd", "secret", "token", "apikey", "api_key", "api-key", "credential", "bearer", "authorization", "private_key", "private key", "access_key", "access key", "signing key", "client key", "passphrase")
_NEAR = re.compile("|".join(map(re.escape, SENSITIVE)), re.I | re.A)
SHORT = 12  # characters of a candidate, at least
_CANDIDATE = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*|[A-Za-z0-9+/_=!@#$%^*~-]{12,}")
_DOMAIN = re.compile(r"\.[A-Za-z]")
_WORDS = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}(?![a-z])")
REACH = 48  # characters between the sensitive word and the candidate at most
AROUND = 512  # characters on either side that the compressor sees first
#: Marginal bits a character: of strings of 16 characters or more with letters and digits; of shorter ones, or without.
MIN_BITS, PLAIN_BITS = 4.5, 6.0
LONG, PLAIN = 16, 20  # characters: see needed()
WORDY = 0.85  # share of a string that lies in words, beyond which it is made of them

#: Identifiers, keywords and words that code and configuration repeat.
IDENTIFIERS = " ".join(
    "import from return function class public private static const string boolean integer value default config configuration settings environment variable "
    "username user_name password passwd secret token access_token refresh_token authorization authentication bearer credential credentials client_id client_secret "
    "api_key apikey private_key public_key signature algorithm encoding application/json content-type localhost https://www.example.com/index.html http://127.0.0.1:8080/ "
    "/usr/local/bin /etc/config /home/user getElementById addEventListener toString hashCode equals length substring database connection hostname "
    "AbstractFactoryBuilderImpl request response session_id created_at updated_at description identifier parameters arguments exception message handler "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 xxxxxxxxxxxxxxxx 0000000000000000 ________________ ---------------- ================".split()
).encode()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed shapes, in code points; leftmost and not overlapping within a kind."""
    spans = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        spans += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"x" * 24 in text.encode("utf-8", "surrogatepass").translate(_HEX_MAP):
        spans += [("hex", m.start(), m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return spans


class Novelty:
    """Marginal compressed bits a character of a string after its surroundings."""

    def __init__(self, identifiers: bytes = IDENTIFIERS, level: int = 3):
        primed = zstandard.ZstdCompressionDict(identifiers, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.zip = zstandard.ZstdCompressor(level=level, dict_data=primed, write_checksum=False, write_content_size=False)

    def bits(self, around: str, candidate: str) -> float:
        a, c = around.encode("utf-8", "surrogatepass"), candidate.encode("utf-8", "surrogatepass")
        return 8 * (len(self.zip.compress(a + c)) - len(self.zip.compress(a))) / len(c)


def _blanked(text: str, s: int, e: int, spans: list[tuple[int, int]]) -> str:
    """text[s:e] with the spans (ascending, none within another) replaced by a space each."""
    s, out = max(0, s), []
    for a, b in spans[bisect_right(spans, s, key=lambda x: x[1]) :]:
        if a >= e:
            break
        out.append(text[s : max(s, a)])
        s = min(b, e)
    return " ".join([*out, text[s:e]])


def needed(own: str, min_bits: float = MIN_BITS) -> float | None:
    """Marginal bits a character from which on a string is reported; None if it is no candidate.

    Random strings of few kinds of characters differ from names by length alone: without digits, words (of either
    case, and in camel case) are no candidates unless one of them has PLAIN letters or more. Digits alone are none.
    """
    if not any(c.isalpha() for c in own):
        return None
    plain = max(min_bits, PLAIN_BITS)
    if any(c.isdigit() for c in own):
        return min_bits if len(own) >= LONG else plain
    words = [len(m[0]) for m in _WORDS.finditer(own)]
    if len(own) < LONG or sum(words) > WORDY * len(own) and max(words) < PLAIN:
        return None
    return min_bits if words and max(words) >= PLAIN else plain


def candidates(text: str) -> list[tuple[int, int]]:
    """Places of strings that start or end within REACH characters of a sensitive word; of one that holds such a word,
    what comes after it."""
    near = [m.span() for m in _NEAR.finditer(text)]
    starts, ends = [s for s, _ in near], [e for _, e in near]
    out = []
    for m in _CANDIDATE.finditer(text):
        s, e = m.span()
        i = bisect_left(starts, e)  # words from here on begin behind the string
        if i and ends[i - 1] > s:
            s = ends[i - 1]
        if e - s < SHORT or "@" in m[0] and _DOMAIN.match(text, e):  # an address
            continue
        if i and s - ends[i - 1] <= REACH or i < len(near) and starts[i] - e <= REACH:
            out.append((s, e))
    return out


def novel_spans(text: str, taken: list[tuple[str, int, int]], novelty: Novelty, min_bits: float = MIN_BITS) -> list[tuple[str, int, int]]:
    """Candidates near a sensitive word that the fixed shapes miss and that hardly compress.

    One secret does not make another known: the compressor sees neither the fixed shapes nor the other candidates,
    nor copies of the string. One that is news at one of its places is reported at all of them.
    """
    low = text.lower()
    if not any(w in low for w in SENSITIVE):
        return []
    found = [(s, e) for s, e in candidates(text) if needed(text[s:e], min_bits) is not None and not any(s < b and a < e for _, a, b in taken)]
    hidden: list[tuple[int, int]] = []
    for s, e in sorted([*found, *((a, b) for _, a, b in taken)]):
        if hidden and s < hidden[-1][1]:
            hidden[-1] = (hidden[-1][0], max(e, hidden[-1][1]))
        else:
            hidden.append((s, e))
    news: set[str] = set()
    for s, e in found:
        own = text[s:e]
        if own not in news:
            size = AROUND + len(own)
            before = _blanked(text, s - size, s, hidden).replace(own, " ")[-AROUND:]
            after = _blanked(text, e, e + size, hidden).replace(own, " ")[:AROUND]
            if novelty.bits(before + after, own) >= needed(own, min_bits):
                news.add(own)
    return [("novel", s, e) for s, e in found if text[s:e] in news]


_shared: dict[str, Novelty] = {}


def scan(text: str | None, min_bits: float = MIN_BITS) -> list[tuple[str, int, int]]:
    """All spans of one text by start, then by kind as listed; None is an empty text."""
    if not text:
        return []
    base = base_spans(text)
    novelty = _shared.get("n") or _shared.setdefault("n", Novelty())
    return sorted(base + novel_spans(text, base, novelty, min_bits), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str | None, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str | None:
    """text with each span, or run of overlapping spans, replaced by mark."""
    if not spans:
        return text
    out, at, end = [], 0, -1
    for _, s, e in spans:
        if s >= end or end < 0:
            out += [text[at:s], mark] if s >= at else []
        end = max(end, e)
        at = end
    return "".join(out) + text[at:]


_SPANS = "array<struct<kind:string,start:long,end:long>>"


def secret_scan(docs: DataFrame, text: str = "text", min_bits: float = MIN_BITS) -> DataFrame:
    """docs with secret_spans: kind, start and end (code points, end exclusive) by start. Null and empty texts have
    none; repeated rows are scanned each; a column of that name is replaced. No shuffle."""
    spans = column_udf(lambda t: [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in scan(x, min_bits)] for x in t], _SPANS)
    return docs.select(*without(docs, "secret_spans"), spans(F.col(text)).alias("secret_spans"))


def redact_secrets(docs: DataFrame, text: str = "text", min_bits: float = MIN_BITS) -> DataFrame:
    """docs with every secret in text replaced by [SECRET]; texts without secrets, nulls included, stay as they are."""
    clean = column_udf(lambda t: [redact(x, scan(x, min_bits)) for x in t], "string")
    return docs.select(*[clean(F.col(c)).alias(c) if c == text else F.col(c) for c in docs.columns])
