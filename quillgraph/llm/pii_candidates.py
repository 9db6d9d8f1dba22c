"""Candidates for personal data: base patterns, generators that propose overlapping spans, and their features."""

from __future__ import annotations

import re

import numpy as np

#: Base kinds first, as the contract lists them; the method adds spans of any kind.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban")
# Fixed values of the contract.
EMAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # a start inside a run of digits fails where the run's start fails
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

DIGITS = re.compile(r"[0-9]+")
CHAIN = re.compile(r"[0-9](?:[ ().,/-]{0,2}[0-9])++")
AT = r"(?:&#64;|\x20?[(\[{]\x20?(?:at|@)\x20?[)\]}]\x20?|\x20at\x20|\x20?@\x20?)"
DOT = r"(?:\x20?[(\[{]\x20?(?:dot|\.)\x20?[)\]}]\x20?|\x20dot\x20|\.)"
MAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{AT}[A-Za-z0-9-]{{1,63}}(?:{DOT}[A-Za-z0-9-]{{1,63}})+", re.IGNORECASE | re.ASCII)
V6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
V4 = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\x20?[(\[]\.[)\]]\x20?[0-9]{1,3}){3}(?![0-9])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: Groups of digits that a written number has at most, and the digits that kinds of numbers have.
MOST_GROUPS = 6
PHONE_DIGITS, CARD_DIGITS = (7, 15), (12, 19)

# Words near a span that speak for a kind, and against any.
CUES = (
    ("email", "mail", "contact", "write", "reach", "address"),
    ("ip", "host", "server", "address", "ping", "client"),
    ("card", "visa", "credit", "payment", "mastercard", "amex", "debit"),
    ("phone", "tel", "call", "mobile", "fax", "cell", "contact", "dial"),
    ("ssn", "social", "security", "taxpayer"),
    ("iban", "account", "bank", "transfer", "bic"),
)
AGAINST = ("isbn", "issn", "doi", "version", "order", "invoice", "page", "pages", "date", "serial", "id", "ref", "model", "sku", "price", "total", "time", "no", "part", "item", "lot", "build", "patent")
WORDS = re.compile(r"[A-Za-z]+")
NEAR = 48
TOP_LEVEL = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "it", "uk", "info")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(text: str) -> bool:
    t = text.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(place in KINDS, start, end) of the base patterns, by kind, then start. Linear in the text's length."""
    found = []
    at, low = text.find("@"), 0
    while at >= 0:
        start = low + len(text[low:at].rstrip(LOCAL))
        host = EMAIL_HOST.match(text, at) if start < at else None
        low = host.end() if host else at + 1
        if host:
            found.append((0, start, low))
        at = text.find("@", low)
    found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Proposals of the generators that overlap no base span; they may overlap each other."""
    found = [(0, m.start(), m.end()) for m in MAIL.finditer(text)]
    found += [(1, m.start(), m.end()) for p in (V6, V4) for m in p.finditer(text)]
    found += [(5, m.start(), m.end()) for m in IBAN.finditer(text)]
    for chain in CHAIN.finditer(text):
        groups = [(m.start(), m.end()) for m in DIGITS.finditer(text, chain.start(), chain.end())]
        for i, (start, _) in enumerate(groups):
            digits = 0
            for j in range(i, min(i + MOST_GROUPS, len(groups))):
                digits += groups[j][1] - groups[j][0]
                if digits > CARD_DIGITS[1]:
                    break
                end = groups[j][1]
                opened = start - (start > 0 and text[start - 1] == "(" and ")" in text[start:end])
                if PHONE_DIGITS[0] <= digits <= PHONE_DIGITS[1]:
                    found.append((3, opened, end))
                if CARD_DIGITS[0] <= digits:
                    found.append((2, start, end))
                if digits == 9 and j - i in (0, 2):
                    found.append((4, start, end))
    if base:
        order = sorted((s, e) for _, s, e in base)
        starts, ends = np.array([s for s, _ in order]), np.maximum.accumulate([e for _, e in order])
        found = [c for c in found if (k := int(np.searchsorted(starts, c[2], "left"))) == 0 or ends[k - 1] <= c[1]]
    return found


def _side(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3 if c in "\"'()[]{}<>,;:!?" else 4


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format of the span, then its context of NEAR characters on both sides."""
    span = text[start:end]
    groups = DIGITS.findall(span)
    sizes = [len(g) for g in groups] or [0]
    digits = "".join(groups)
    marks = [c for c in span if not c.isalnum()]
    letters = sum(map(str.isalpha, span))
    years = sum(len(g) == 4 and 1800 <= int(g) <= 2100 for g in groups)
    date = 2 <= len(groups) <= 3 and years == 1 and all(len(g) == 4 or int(g) <= 31 for g in groups)
    labels = re.split(r"[^A-Za-z0-9-]+", span)
    national = len(digits) in (10, 11) and digits[-10] in "23456789" and digits[-7] in "23456789" and (len(digits) == 10 or digits[0] == "1")
    social = len(digits) == 9 and digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    left, right = [w.lower() for w in WORDS.findall(before)], [w.lower() for w in WORDS.findall(after)]
    cue = [len(left) - i for i, w in enumerate(left) if w in CUES[kind]]
    stop = [len(left) - i for i, w in enumerate(left) if w in AGAINST]
    check = mod97(span) if kind == 5 else luhn(digits) if digits else False
    return [
        *(float(kind == k) for k in range(len(KINDS))),
        len(span), len(digits), letters, len(groups), sizes[0], sizes[1] if len(sizes) > 1 else 0, sizes[-1], max(sizes), min(sizes),
        len(marks), len(set(marks)), span.count(" "), span.count("-"), span.count("."), span.count("/") + span.count(","), span.count(":"), "::" in span, span.startswith("("), "[" in span or "{" in span, "(" in span,
        digits.startswith("0"), digits.startswith("00"), digits[:2] in ("34", "37"), digits[:1] in ("4", "5"), years, date, len(set(digits)), check, national, social,
        labels[-1].lower() in TOP_LEVEL, len(labels[-1]), " at " in span.lower() or " dot " in span.lower(),
        _side(before[-1:]), _side(after[:1]), before[-2:-1].isdigit(), after[1:2].isdigit(), bool(before[-1:]) and before[-1] in "$€£#+.-/_=@" , bool(after[:1]) and after[0] in "%-/_=@+",
        min(cue, default=99), sum(w in CUES[kind] for w in right[:3]), min(stop, default=99), sum(map(str.isdigit, before)), sum(map(str.isdigit, after)), sum(map(str.isalpha, before)), sum(map(str.isalpha, after)),
    ]


N_FEATURES = len(features("", 0, 0, 0))
