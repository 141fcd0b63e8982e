"""Personal data: expressions propose spans, checksums confirm them, nearby words adjust the score.

Every span has a score from 0 to 1: what its kind starts with, raised where a telling word stands nearby and lowered
where a word speaks against it. The four base kinds (email, ip, card, phone) are found by leftmost non-overlapping
matching and kept whatever their score. Further kinds (iban, ssn, tel, secret) are proposed by expressions, confirmed
where a check exists (mod 97 for iban, number ranges for ssn, the decoded header of signed tokens) and kept when the
score reaches KEEP. Secrets are found behind a keyword and by the public formats of keys; a secret is taken whole,
however long. Added spans inside a base span are left out, overlapping secrets are one.

Defined results: a null text counts as empty (no spans, the digest of an empty string); repeated rows give repeated
results; an empty table gives no rows; only doc_id and text are looked at. Time is linear in the text: runs of
letters, digits or signs are walked once.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, table, text_pass

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "tel", "secret")
#: Least score of an added span; what a telling word adds, a contrary one takes, and how far away they may stand.
KEEP, NEARBY, AGAINST, REACH = 0.6, 0.4, 0.3, 48
COLUMNS = "doc_id long,n_email long,n_ip long,n_card long,n_phone long,base_sha256 string,spans string,scores string"

_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_digits = re.compile(r"[0-9]+")
_ip = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_iban = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
#: Country codes of account numbers with their lengths, as published in the registry.
IBAN_LENGTHS = {
    code[:2]: int(code[2:])
    for code in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 "
        "FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 "
        "LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 "
        "SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
#: By length, that many letters and digits with single spaces between.
_account = {n: re.compile(rf"[A-Z0-9](?: ?[A-Z0-9]){{{n - 1}}}(?![A-Za-z0-9])") for n in set(IBAN_LENGTHS.values())}
_ssn = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_tel = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_keyed = re.compile(
    r"(?i)(?<![a-z])(?:token|secret|password|passwd|pwd|(?:api|access|private)[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?:bearer\s)?"
    r"([a-z0-9+/_=.~-]{20,})"
)
#: Public formats of keys (cloud key ids, code hosts, chat, maps, payments).
_formats = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z2-7]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}"
    r"|AIza[A-Za-z0-9_-]{35}|[rs]k_live_[A-Za-z0-9]{16,})"
)
_signed = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]*)\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_block = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,40}-----)?")
#: What a text without digits must hold to have an added span.
_WITHOUT_DIGITS = ("PRIVATE KEY", "AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "AIza", "k_live_", "eyJ")
#: Score without a word nearby, the words that tell, and those that speak against it.
SCORES = {
    "email": (0.9, r"e-?mail|mail|contact|courriel|correo", r"example|noreply"),
    "ip": (0.6, r"ip|host|server|address|adresse", r"version|release|section"),
    "card": (0.7, r"card|visa|mastercard|amex|credit|karte|carte|tarjeta", r"isbn|order|serial|tracking"),
    "phone": (0.7, r"tel|phone|call|mobile|fax|telefon|téléphone|teléfono", r"version|serial"),
    "iban": (0.8, r"iban|konto|compte|account|bank|cuenta", r"serial|part|model"),
    "ssn": (0.4, r"ssn|social security|tax id", r"part|serial|order|model"),
    "tel": (0.3, r"tel|phone|call|mobile|fax|telefon|téléphone|teléfono", r"serial|part|order"),
    "secret": (0.7, r"key|secret|token|password", r"placeholder|dummy"),
}
_telling = {k: re.compile(rf"(?i)\b(?:{words})\b") for k, (_, words, _) in SCORES.items()}
_contrary = {k: re.compile(rf"(?i)\b(?:{words})\b") for k, (_, _, words) in SCORES.items()}
#: The sum of the digits of twice a digit.
_TWICE = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers: as long as their country has them, and passing mod 97; what follows does not matter."""
    for start in _iban.finditer(text):
        if length := IBAN_LENGTHS.get(start[0][:2]):
            whole = _account[length].match(text, start.start())
            if whole and mod97(whole[0].replace(" ", "")):
                yield whole.span()


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[::-2])) + sum(_TWICE[int(c)] for c in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    rest = 0
    for c in iban[4:] + iban[:4]:
        rest = (rest * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return rest == 1


def _issued(area: str, group: str, serial: str) -> bool:
    """Whether a social security number lies in the ranges that are given out."""
    return 0 < int(area) < 900 and int(area) != 666 and int(group) > 0 and int(serial) > 0


def _is_header(part: str) -> bool:
    """Whether the first part of a signed token is the header that such tokens have."""
    try:
        return b'"alg"' in base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))
    except (binascii.Error, ValueError):
        return False


def _in_range(ip: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and (not p or int(p) <= 255) for part in ip.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as in BASE, then by start; code points, end exclusive."""
    emails, ips, cards, phones = [], [], [], []
    if "@" in text:
        free = 0
        for m in _domain.finditer(text):
            at = m.start()
            while at > free and text[at - 1] in _local:
                at -= 1
            if at < m.start():
                emails.append(("email", at, m.end()))
                free = m.end()
    ip_free = card_free = 0
    for run in _digits.finditer(text):
        at = run.start()
        if at >= ip_free and (m := _ip.match(text, at)):
            ip_free = m.end()
            if _in_range(m[0]):
                ips.append(("ip", at, ip_free))
        if at >= card_free and (m := _card.match(text, at)):
            card_free = m.end()
            number = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(number) <= 19 and luhn(number):
                cards.append(("card", at, card_free))
    if "+" in text:
        for m in _phone.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                phones.append(("phone", m.start(), m.end()))
    return emails + ips + cards + phones


def score(text: str, kind: str, start: int, end: int) -> float:
    """What the kind starts with, moved by the words around the span."""
    before, after = max(0, start - REACH), min(len(text), end + REACH)
    moved = SCORES[kind][0]
    near = lambda words: words.search(text, before, start) or words.search(text, end, after)
    if near(_telling[kind]):
        moved += NEARBY
    if near(_contrary[kind]):
        moved -= AGAINST
    return round(min(max(moved, 0.0), 1.0), 2)


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    for m in _keyed.finditer(text):
        end = m.start(1) + len(m[1].rstrip("."))
        if end - m.start(1) >= 20 and _digits.search(text, m.start(1), end):
            yield m.start(1), end
    for m in _formats.finditer(text):
        yield m.span()
    for m in _signed.finditer(text):
        if _is_header(m[1]):
            yield m.span()
    for m in _block.finditer(text):
        yield m.start(), m.start() + len(m[0].rstrip())


def added_spans(text: str, base: list[tuple[str, int, int]] = ()) -> list[tuple[str, int, int, float]]:
    """Spans of the further kinds with their scores, by kind as in ADDED, then by start; none inside a base span."""
    secrets: list[tuple[int, int]] = []
    for a, b in sorted(_secrets(text)):
        if secrets and a < secrets[-1][1]:
            secrets[-1] = secrets[-1][0], max(secrets[-1][1], b)
        else:
            secrets.append((a, b))
    proposed = [("iban", *span) for span in ibans(text)]
    proposed += [("ssn", *m.span()) for m in _ssn.finditer(text) if _issued(*m.groups())]
    proposed += [("tel", *m.span()) for m in _tel.finditer(text)]
    proposed += [("secret", *s) for s in secrets]
    covers = sorted((a, b) for _, a, b in base)
    found, at = [], 0
    for kind, a, b in sorted(proposed, key=lambda x: x[1]):
        while at < len(covers) and covers[at][1] <= a:
            at += 1
        inside = any(x <= a and b <= y for x, y in covers[at : at + len(BASE)])
        if not inside and (own := score(text, kind, a, b)) >= KEEP:
            found.append((kind, a, b, own))
    return sorted(found, key=lambda x: (ADDED.index(x[0]), x[1]))


def spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int, float]]]:
    base = base_spans(text)
    asked = _digits.search(text) is not None or any(x in text for x in _WITHOUT_DIGITS)
    return base, added_spans(text, base) if asked else []


def _joined(found) -> str:
    return ",".join(":".join(map(str, x)) for x in found)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, text -> counts of the base kinds, digest of the base spans, all spans, and all with scores; no shuffle."""

    def make() -> Callable:
        def work(doc_ids, texts):
            for doc_id, text in zip(doc_ids, texts, strict=True):
                base, added = spans(text or "")
                counts = [sum(x[0] == kind for x in base) for kind in BASE]
                scored = [(*x, score(text, *x)) for x in base] + added
                yield (
                    doc_id,
                    *counts,
                    hashlib.sha256(_joined(base).encode()).hexdigest(),
                    _joined(x[:3] for x in scored),
                    _joined(scored),
                )

        return work

    return text_pass(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, COLUMNS)


def masked(text: str) -> str:
    """The text with every span, overlapping ones as one, replaced by its (first) kind in angle brackets."""
    base, added = spans(text)
    ordered = sorted((x[1], x[2], x[0]) for x in [*base, *added])
    out, at = [], 0
    for start, end, kind in ordered:
        if start < at:
            at = max(at, end)
            continue
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """Documents with personal data masked; n_chars, if there is one, follows the text, other columns pass through."""

    packed = docs.select(F.struct(*columns_of(docs)).alias("row"))

    def run(batches):
        for batch in batches:
            rows = batch.column(0)
            fields, columns = list(rows.type), rows.flatten()
            names = [f.name for f in fields]
            clean = [None if t is None else masked(t) for t in columns[names.index("text")].to_pylist()]
            for i, f in enumerate(fields):
                if f.name == "text":
                    columns[i] = pa.array(clean, f.type)
                elif f.name == "n_chars":
                    columns[i] = pa.array([n if t is None else len(t) for t, n in zip(clean, columns[i].to_pylist(), strict=True)], f.type)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns, fields=fields)], names=["row"])

    return packed.mapInArrow(run, packed.schema).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))
