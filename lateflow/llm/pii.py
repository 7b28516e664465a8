"""Personal data: regular expressions propose spans, validators confirm them, nearby words adjust the score.

Four base rules propose e-mail addresses, IP addresses, card numbers and phone numbers, leftmost and
not overlapping within a kind; a proposal that fails its validator (parts of at most 255, Luhn, number of digits)
is dropped and not tried again in another way. Base spans always stay.

Further rules add spans, each with a prior score below, at or above the threshold:
IBANs (length by country and mod-97), card numbers set apart by dots or wide blanks (Luhn), social security
numbers (allotted areas), national phone numbers, IPv6 addresses and spelled-out e-mail addresses.
Words within ``reach`` characters raise a score (they name the kind) or lower it (they name another kind of number);
an added span stays from ``least`` on, unless it overlaps a base span or an added one of higher score. An IBAN is
confirmed by its own checksum and may hold a base card span.

Proposals are found in time linear in the text: patterns start at a rare character or take whole runs
possessively, so a text of one long word or number costs no more than prose. Each text is scanned whole
in the task that reads it; nothing is shuffled.

Defined cases: null and empty texts have no spans, and the digest of an empty string; bytes that are no UTF-8
count as one U+FFFD each; offsets are code points, ends exclusive; of added spans with equal scores the earlier
one stays, then the longer; repeated rows and ids each give a row; an empty table gives no rows; further
columns are read only if named in ``keep``.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lateflow.llm.common import texts

#: Order of kinds in outputs.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")

# Lengths of IBANs by country, of the public ISO 13616 registry.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 "
    "GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 "
    "MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float
    base: bool


# Validators.


def digits(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def luhn(value: str) -> bool:
    """The sum of a card number's digits, every second one from the right doubled, ends in 0."""
    total = 0
    for i, c in enumerate(reversed(digits(value))):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The first four characters moved to the end and letters read as 10 to 35, the number leaves 1 on division by 97."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def ip_parts(value: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in value.split("."))


def is_card(value: str) -> bool:
    return 13 <= len(digits(value)) <= 19 and luhn(value)


def is_phone(value: str) -> bool:
    return 9 <= len(digits(value)) <= 15


def is_ssn(value: str) -> bool:
    area, group, serial = value.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def is_ip6(value: str) -> bool:
    try:
        return sum(map(bool, ipaddress.IPv6Address(value).compressed.split(":"))) >= 3
    except ValueError:
        return False


# Proposals: (start, end) of candidates, in order and apart from each other.

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, sought from each ``@``: what may stand
    before it is all of its run, back to the last ``@`` or match."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


_DOTTED = re.compile(r"[0-9][0-9.]*+")
_FOUR = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Matches of four numbers joined by dots, sought within runs of digits and dots."""
    for run in _DOTTED.finditer(text):
        if run.end() - run.start() >= 7 and run[0].count(".") >= 3:
            for m in _FOUR.finditer(run[0]):
                yield run.start() + m.start(), run.start() + m.end()


_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def cards(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 13)


def phones(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _PHONE.finditer(text))


_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?<![A-Za-z0-9][A-Z]{2}[0-9]{2})(?:\x20?[A-Z0-9]){11,30}+")
_LENGTH = {x[:2]: int(x[2:]) for x in IBAN_LENGTHS.split()}


def ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        left, end = _LENGTH.get(m[0][:2], 0), m.start()
        while left and end < m.end():
            left -= text[end] != " "
            end += 1
        after = text[end : end + 1]
        if not left and m[0][:2] in _LENGTH and not (after.isascii() and after.isalnum()) and mod97(text[m.start() : end].replace(" ", "")):
            yield m.start(), end


_SPACED = re.compile(r"[0-9]{4}(?:[.\xa0\x20]{1,2}[0-9]{4}){3}")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_NATIONAL = re.compile(r"(?:\([0-9]{2,5}\)\x20?[0-9]{3,4}[\x20.-]|[0-9]{2,5}([\x20./-])[0-9]{3,4}\1)[0-9]{3,4}")


def apart(pattern: re.Pattern, near: str) -> Callable[[str], Iterator[tuple[int, int]]]:
    """Matches with none of the characters ``near`` (or a letter or digit) right before or after them."""

    def find(text: str) -> Iterator[tuple[int, int]]:
        for m in pattern.finditer(text):
            edges = text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1]
            if not any(c.isalnum() or c in near for c in edges):
                yield m.span()

    return find


_HEX = "0123456789abcdefABCDEF:"
_HEX_RUN = re.compile(r"[0-9A-Fa-f:]{0,40}")


def ip6s(text: str) -> Iterator[tuple[int, int]]:
    """Runs of hexadecimal digits and colons of up to 40 characters around a colon."""
    at = text.find(":")
    while at >= 0:
        begin = max(0, at - 5)
        start = begin + len(text[begin:at].rstrip(_HEX))
        end = _HEX_RUN.match(text, at).end()
        edges = text[max(0, start - 1) : start] + text[end : end + 1]
        if end - start >= 7 and text.count(":", start, end) >= 2 and not any(c.isalnum() or c in ":." for c in edges):
            yield start, end
        at = text.find(":", max(end, at + 1))


_AT = re.compile(r"\x20?(?:\[at\]|\(at\)|\{at\})\x20?", re.I)
_SPELLED = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?(?:\[dot\]|\(dot\)|\{dot\})\x20?)[A-Za-z0-9-]{1,63})+", re.I)


def spelled_emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with ``[at]`` for the at sign, and ``[dot]`` or dots in the domain."""
    free = 0
    for m in _AT.finditer(text):
        if m.start() < free:
            continue
        start = free + len(text[free : m.start()].rstrip(LOCAL))
        found = _SPELLED.match(text, m.end()) if start < m.start() else None
        if found:
            yield start, found.end()
        free = found.end() if found else m.end()


class Rule(NamedTuple):
    kind: str
    propose: Callable[[str], Iterable[tuple[int, int]]]
    valid: Callable[[str], bool] | None
    prior: float
    base: bool = False


RULES = (
    Rule("email", emails, None, 0.8, True),
    Rule("ip", ips, ip_parts, 0.6, True),
    Rule("card", cards, is_card, 0.7, True),
    Rule("phone", phones, is_phone, 0.7, True),
    Rule("iban", ibans, None, 0.9),
    Rule("email", spelled_emails, None, 0.55),
    Rule("ip", ip6s, is_ip6, 0.55),
    Rule("card", apart(_SPACED, ".-"), is_card, 0.45),
    Rule("ssn", apart(_SSN, "-."), is_ssn, 0.35),
    Rule("phone", apart(_NATIONAL, "+-/:,"), is_phone, 0.3),
)
RAISE = {
    "email": "e-?mail|mail|contact|correo|courriel|kontakt",
    "ip": "ip|host|server|address|login|adresse",
    "card": "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta",
    "phone": "phone|tel|telephone|telefon|téléphone|teléfono|mobile|mobil|cell|fax|call|whatsapp",
    "iban": "iban|account|konto|compte|cuenta|bank|banque|banco",
    "ssn": "ssn|social security|social insurance",
}
LOWER = "order|invoice|isbn|issn|version|build|ticket|part|serial|sku|ref|bestellung|rechnung|commande|facture|pedido"
_RAISE = {k: re.compile(rf"\b(?:{v})\b", re.I) for k, v in RAISE.items()}
_LOWER = re.compile(rf"\b(?:{LOWER})\b", re.I)


def find_spans(text: str, least: float = 0.5, reach: int = 48) -> list[Span]:
    """All spans of a text, by kind and start; base spans first among those that start together."""
    kept: list[Span] = []
    added: list[Span] = []
    for rule in RULES:
        for start, end in rule.propose(text):
            if rule.valid and not rule.valid(text[start:end]):
                continue
            near = f"{text[max(0, start - reach) : start]} \n {text[end : end + reach // 2]}"
            score = rule.prior + 0.25 * bool(_RAISE[rule.kind].search(near)) - 0.25 * bool(_LOWER.search(near))
            span = Span(rule.kind, start, end, round(min(1.0, max(0.0, score)), 2), rule.base)
            (kept if rule.base else added).append(span)
    if added:
        base = [(s.start, s.end, s.kind) for s in kept]
        for s in sorted((s for s in added if s.score >= least), key=lambda s: (-s.score, s.start, -s.end)):
            free = all(s.end <= a or b <= s.start or (s.kind == "iban" and kind in ("card", "phone")) for a, b, kind in base)
            if free:
                kept.append(s)
                base.append((s.start, s.end, s.kind + " added"))
    return sorted(kept, key=lambda s: (KINDS.index(s.kind), s.start, not s.base, s.end))


def listed(spans: Iterable[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])
_FOUND = {
    **{f"n_{k}": "bigint" for k in KINDS[:4]},
    "base_sha256": "string",
    "spans": "string",
    "n_added": "bigint",
    "found": "array<struct<kind: string, start: bigint, end: bigint, score: double, base: boolean>>",
}


def find_pii(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    outputs: tuple[str, ...] = tuple(_FOUND),
    least: float = 0.5,
    reach: int = 48,
) -> DataFrame:
    """Per row: counts of the base spans by kind, the digest of their list, the list of all spans, how many were added, and ``found``, the spans with their scores."""
    chosen = docs.select(F.col(id_col), *keep, F.col(text_col).cast("string").alias("_text"))
    names = [id_col, *keep, *outputs]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                all_spans = [find_spans(t, least, reach) for t in texts(part.column(part.num_columns - 1))]
                base = [[s for s in spans if s.base] for spans in all_spans]
                column = {f"n_{k}": lambda k=k: pa.array([sum(s.kind == k for s in b) for b in base], pa.int64()) for k in KINDS[:4]}
                column |= {
                    "base_sha256": lambda: pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b in base], pa.string()),
                    "spans": lambda: pa.array([listed(s) for s in all_spans], pa.string()),
                    "n_added": lambda: pa.array([len(s) - len(b) for s, b in zip(all_spans, base)], pa.int64()),
                    "found": lambda: pa.array([[s._asdict() for s in spans] for spans in all_spans], pa.list_(_SPAN)),
                }
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(column[c]() for c in outputs)], names)

    made = T.StructType.fromDDL(", ".join(f"{c} {_FOUND[c]}" for c in outputs))
    return chosen.mapInArrow(run, T.StructType([*chosen.schema.fields[:-1], *made.fields]))
