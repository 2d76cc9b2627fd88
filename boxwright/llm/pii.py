"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust a score.

Base kinds (email, ip, card, phone) follow fixed rules and are always kept by spans(). Added kinds are kept
from a score of LEAST: an account number (IBAN) of its country's length that passes mod-97, a social security
number, and a secret: a private key block, a key of a known form, or a random string of KEY_LENGTH characters
or more (ENTROPY bits for each character, digits among them) that a word such as token or password announces
or that is hexadecimal. A span's score is its kind's PRIOR, and BONUS more where a word of CONTEXT stands
within NEAR code points of it.

Cases: null and empty texts have no spans, an empty table gives an empty result. Texts are scanned whole and
in linear time, whatever their length. Offsets are code points, the end exclusive. Rows are independent, so
ties and repeated rows need no rule. find_digests and find take doc_id and text alone; redact keeps every
other column, whatever its name.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm.common import tidy

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
_ORDER = {k: i for i, k in enumerate(KINDS)}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Greedy digits always end at a run's end, so a match can only start at a run's start.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}(?=[\x20A-Za-z0-9])")
# The registered length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
_IBAN_OF = {n: re.compile(rf"[A-Za-z0-9](?:\x20?[A-Za-z0-9]){{{n - 1}}}(?![A-Za-z0-9])") for n in set(IBAN_LENGTHS.values())}
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
KEY_LENGTH, ENTROPY = 16, 3.0
ANNOUNCED = re.compile(r"(?:key|secret|token|passwo?r?d|passwd|pwd|bearer|credential)s?[\"']?\s{0,4}(?:[:=]{1,2}|=>|\s)\s{0,4}[\"']?([A-Za-z0-9+/_=.~-]++)", re.I)
HEX = re.compile(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,}+(?![A-Za-z0-9])")
# How keys of well-known services begin, and their least length.
KNOWN = re.compile(r"(?<![A-Za-z0-9_-])(?:A[KS]IA[0-9A-Z]{16}(?![0-9A-Z])|gh[pousr]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{22,}+|sk-[A-Za-z0-9_-]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)")
BLOCK, BLOCK_END = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"), re.compile(r"-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----")
CONTEXT = {
    "email": re.compile(r"\b(e-?mail|mail|contact|kontakt|correo|courriel)\b", re.I),
    "ip": re.compile(r"\b(ip|host|server|address|adresse)\b", re.I),
    "card": re.compile(r"\b(card|visa|mastercard|credit|karte|tarjeta|carte)\b", re.I),
    "phone": re.compile(r"\b(phone|tel|mobile|call|fax|telefon|tel[ée]fono|t[ée]l[ée]phone)\b", re.I),
    "iban": re.compile(r"\b(iban|account|konto|cuenta|compte|bank)\b", re.I),
    "ssn": re.compile(r"\b(ssn|social\s+security)\b", re.I),
    "secret": re.compile(r"(key|secret|token|passw|pwd|bearer|credential)", re.I),
}
PRIOR = {"email": 0.9, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3, "secret": 0.4}
NEAR, BONUS, LEAST = 40, 0.4, 0.5
FOUND = "doc_id long, spans array<struct<kind: string, start: int, end: int, score: double>>"
DIGESTS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

Span = tuple[int, str, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: for each @, the longest local part after the last match."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            floor = m.end()
        else:
            floor = max(floor, at + 1)
        at = text.find("@", floor)


def phones(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("+")
    while at >= 0:
        if m := PHONE.match(text, at):
            yield m.span()
            at = text.find("+", m.end())
        else:
            at = text.find("+", at + 1)


def base_spans(text: str) -> list[Span]:
    out: list[Span] = [(a, "email", b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), "ip", m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), "card", m.end()))
    for a, b in phones(text):
        if 9 <= sum(c.isdigit() for c in text[a:b]) <= 15:
            out.append((a, "phone", b))
    return sorted(out, key=lambda s: (s[0], _ORDER[s[1]]))


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Of each proposed start, so many letters and digits as its country asks for, spaces aside."""
    for m in IBAN.finditer(text):
        n = IBAN_LENGTHS.get(m[0][:2].upper())
        if n and (whole := _IBAN_OF[n].match(text, m.start())) and mod97(whole[0]):
            yield whole.span()


def random_like(key: str) -> bool:
    n = len(key)
    return n >= KEY_LENGTH and any(c.isdigit() for c in key) and -sum(k / n * math.log2(k / n) for k in Counter(key).values()) >= ENTROPY


def secrets(text: str) -> Iterator[tuple[int, int]]:
    """Private key blocks, keys of a known form, and random strings that are announced or hexadecimal; without overlaps."""
    found = [m.span() for m in KNOWN.finditer(text)]
    found += [m.span(1) for m in ANNOUNCED.finditer(text) if random_like(m[1])]
    found += [m.span() for m in HEX.finditer(text) if random_like(m[0])]
    at = 0
    while m := BLOCK.search(text, at):
        if not (end := BLOCK_END.search(text, m.end())):
            break
        found.append((m.start(), end.end()))
        at = end.end()
    at = 0
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        if a >= at:
            yield a, b
            at = b


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's prior, and more with a word of its context nearby; certain for keys of a known form."""
    if kind == "secret" and (KNOWN.match(text, start, end) or BLOCK.match(text, start, end)):
        return 1.0
    around = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
    return min(1.0, PRIOR[kind] + BONUS * bool(CONTEXT[kind].search(around)))


def added_spans(text: str) -> list[Span]:
    found = [("iban", s) for s in ibans(text)]
    found += [("ssn", m.span()) for m in SSN.finditer(text)]
    found += [("secret", s) for s in secrets(text)]
    return [(a, kind, b) for kind, (a, b) in found if score(text, kind, a, b) >= LEAST]


def spans(text: str) -> list[Span]:
    return sorted(base_spans(text) + added_spans(text), key=lambda s: (s[0], _ORDER[s[1]]))


def written(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in found)


def redacted(text: str | None) -> str | None:
    """The text with each span, or each run of overlapping spans, replaced by the first one's kind."""
    found = spans(text) if text else []
    if not found:
        return text
    out, at = [], 0
    for start, kind, end in found:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_digests(docs: DataFrame) -> DataFrame:
    """Per document: number of base spans by kind, a digest of them, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in BASE}
            digests, every = [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                base, more = base_spans(text), added_spans(text)
                kinds = [k for _, k, _ in base]
                for k, c in counts.items():
                    c.append(kinds.count(k))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                every.append(written(sorted(base + more, key=lambda s: (s[0], _ORDER[s[1]]))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts.values()), pa.array(digests, pa.string()), pa.array(every, pa.string())], ["doc_id", *(f"n_{k}" for k in counts), "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), DIGESTS)


def find(docs: DataFrame) -> DataFrame:
    """Per document: all spans with their scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b, "score": score(t, k, a, b)} for a, k, b in spans(t)] for t in (x.as_py() or "" for x in batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), FOUND)


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span in text replaced by its kind; rows and columns stay."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(at, batch.schema.field(at), pa.array([redacted(x.as_py()) for x in batch.column(at)], batch.schema.field(at).type))

    return docs.mapInArrow(tidy(run), docs.schema)
