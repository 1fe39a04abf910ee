"""Personal data and secrets: regular expressions propose spans, validators confirm them, context adjusts a score.

The base kinds (email, ip, card, phone) are what their expressions and checks say, always kept. The other kinds start
from a score (IBANs of their country's length whose check digits are right, bank and social security numbers, national
telephone numbers, keys and tokens whose characters are various enough); words near the span raise or lower it, and spans at THRESHOLD or more
stay, unless they overlap a base span. Each kind's spans are leftmost and don't overlap; spans of different kinds may.

All expressions are written so that a text of n characters takes time in proportion to n.

Defined results: a null text counts as empty, with no span; null ids and repeated rows are kept as they are; an empty
table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, per_text

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "routing", "national_phone", "secret")
BASE = 4
THRESHOLD = 0.6
#: Characters on either side in which context words are looked for.
NEAR = 40

#: The characters that an address may have before its @.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: An IBAN's start, and fixed values: the lengths of IBANs by country.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18,
    "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23,
    "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27,
    "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
    "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
_IBAN_REST = {n: re.compile(rf"(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(IBAN_LENGTHS.values())}
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
ROUTING = re.compile(r"(?<![0-9])[0-9]{9}(?![0-9])")
#: National numbers: three, three and four digits; a French, a Spanish and a German writing.
NATIONAL = re.compile(r"(?<![0-9+])(?:\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|0[1-9](?:[\x20.][0-9]{2}){4}|[6-9][0-9]{2}\x20[0-9]{3}\x20[0-9]{3}|0[0-9]{2,4}[\x20/-][0-9]{5,8})(?![0-9])")
#: Mobile numbers of two countries, written as above: their score starts higher.
MOBILE = re.compile(r"0[67](?:[\x20.][0-9]{2}){4}|01[567][0-9]{1,2}[\x20/-][0-9]{6,8}")
MOBILE_BONUS = 0.1
#: A named secret, whatever words are joined to its name's front by underscores; keys that have a form of their own; blocks of private keys.
SECRET = re.compile(r"(?i:(?<![^\W_])(?:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d|passwd|bearer|auth)\b)[\x20\t]{0,4}(?:[:=][\x20\t]{0,4}|is[\x20\t])?[\"']?(?P<value>[A-Za-z0-9+/_.-]{12,512}={0,2})")
BLOCK = re.compile(r"-----BEGIN (?P<name>[A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?)-----(?s:.{16,20000}?)-----END (?P=name)-----")
KEYS = re.compile(r"\b(?P<value>(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9-]{10,200}|AIza[A-Za-z0-9_-]{35}|sk-[A-Za-z0-9_-]{20,200}|eyJ[A-Za-z0-9_-]{8,2000}\.eyJ[A-Za-z0-9_-]{8,2000}\.[A-Za-z0-9_-]{8,1000})(?![A-Za-z0-9_-])")
#: Bits of entropy a character that a named secret has at least, and digits or capitals among its letters.
ENTROPY = 2.8
DIGITS = re.compile(r"[0-9]")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


#: Start score and context of the kinds that are added: words that raise it by 0.3, words that lower it by 0.3.
CONTEXT = {
    "iban": (0.9, r"iban|bank|account|konto|compte|cuenta|transfer|bic", r"example|sample|invalid"),
    "ssn": (0.5, r"ssn|social|security|tax", r"isbn|part|model|order|version"),
    "routing": (0.3, r"routing|aba|bank|transit|wire", r"isbn|part|model|order|version|issue"),
    "national_phone": (0.5, r"phone|tel|call|mobile|cell|fax|contact|dial|telefon|anruf|handy|téléphone|appel|numéro|teléfono|llama|móvil", r"isbn|part|model|order|version|serial|nummer|commande|facture|pedido"),
    "secret": (0.7, r"key|secret|token|password|auth|api|login|credential", r"example|sample|placeholder|sha1|sha256|md5|commit|checksum"),
}
_CONTEXT = {k: (s, re.compile(rf"(?<!\w)(?:{up})(?!\w)", re.I), re.compile(rf"(?<!\w)(?:{down})(?!\w)", re.I)) for k, (s, up, down) in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) << (k & 1)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def routing(digits: str) -> bool:
    return digits != "000000000" and sum(int(d) * (3, 7, 1)[k % 3] for k, d in enumerate(digits)) % 10 == 0


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Each start with as many characters as its country's IBANs have, if the check digits are right."""
    free = 0
    for m in IBAN.finditer(text):
        rest = _IBAN_REST[IBAN_LENGTHS[m[0][:2]]].match(text, m.end()) if m.start() >= free and m[0][:2] in IBAN_LENGTHS else None
        if rest and mod97(text[m.start() : rest.end()]):
            free = rest.end()
            yield m.start(), free


def random_like(value: str) -> bool:
    """Whether a word's characters are mixed and various enough for a secret."""
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    return entropy >= ENTROPY and any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def secrets(text: str) -> Iterator[tuple[int, int]]:
    found = [m.span("value") for m in SECRET.finditer(text) if random_like(m["value"])]
    found += [m.span("value") for m in KEYS.finditer(text) if not m["value"].startswith("sk-") or random_like(m["value"])]
    found += [m.span() for m in BLOCK.finditer(text)] if "PRIVATE KEY" in text else []
    return iter(_merged(found))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ to the left as far as its characters go, which is where a leftmost match would start."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        # A run is never walked over twice: no address starts before this @.
        free = max(free, at + 1)
        at = text.find("@", free)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in m[0].split("."))):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if len(m[0]) >= 14 and 14 <= len(d := "".join(DIGITS.findall(m[0]))) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(DIGITS.findall(m[0])) <= 15:
                yield m.span()


def _score(kind: str, text: str, start: int, end: int) -> float:
    score, up, down = _CONTEXT[kind]
    if kind == "national_phone" and MOBILE.fullmatch(text, start, end):
        score += MOBILE_BONUS
    near = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
    return min(1.0, max(0.0, score + 0.3 * bool(up.search(near)) - 0.3 * bool(down.search(near))))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same stretches of text, in order and without overlaps."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _hit(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of the merged spans overlaps start to end."""
    k = bisect.bisect_left(spans, (end,)) - 1
    return k >= 0 and spans[k][1] > start


def find(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """All spans, by start and then kind. Offsets are code points."""
    out = [Span(k, *x, 1.0) for k, f in (("email", emails), ("ip", ips), ("card", cards), ("phone", phones)) for x in f(text)]
    taken = _merged([(s.start, s.end) for s in out])
    spans = lambda pattern, valid=None: (m.span() for m in pattern.finditer(text) if valid is None or valid(m[0]))
    more = (("iban", ibans(text)), ("ssn", spans(SSN, lambda s: s[:3] not in ("000", "666") and s[0] != "9")), ("routing", spans(ROUTING, routing)), ("national_phone", spans(NATIONAL)), ("secret", secrets(text)))
    for kind, found in more:
        for start, end in found:
            if not _hit(taken, start, end) and (score := _score(kind, text, start, end)) >= threshold:
                out.append(Span(kind, start, end, score))
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _find(threshold: float, texts: list[str]) -> pa.Array:
    return pa.array([[vars(s) for s in find(t, threshold)] for t in texts], _SPANS)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row per row of docs: doc_id, spans (kind, start, end, score)."""
    spans = per_text(docs.sparkSession, lambda texts: _find(threshold, texts), SPANS, F.col("text"))
    return id_and_text(docs, id_col, text_col).select("doc_id", spans.alias("spans"))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, and the spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:BASE]))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS[:BASE]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def brute(text: str) -> str:
    """The base spans as text, from the plain expressions; for tests on short texts."""
    out = []
    for n, (kind, pattern) in enumerate((("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "card" and 14 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 10 <= len(digits) <= 15):
                out.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(out))


def base_sha256(text: str) -> str:
    return hashlib.sha256(brute(text).encode()).hexdigest()
