"""Personal data: patterns propose spans, checksums confirm them, context words nearby adjust the score.

Every scan is linear in the text: a long run of letters or digits is looked at a fixed number of times.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits begins: earlier ends are ends of runs
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{1,4}){2,8}(?![A-Za-z0-9])")
_SOCIAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NUMBER = re.compile(r"(?<![0-9-])[0-9]{3,4}[\x20.-][0-9]{3,4}[\x20.-]?[0-9]{0,4}(?![0-9-])")
_NO_DIGITS = re.compile(r"[^0-9]")

#: Kinds in the order of the span string; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "social", "short_card", "local_phone")
#: Words that raise the score of an added kind when they stand near it.
CONTEXT = {
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank", "banque", "banco"),
    "social": ("ssn", "social", "security", "insurance", "sécurité", "sozialversicherung", "seguridad"),
    "short_card": ("card", "visa", "amex", "credit", "karte", "carte", "tarjeta", "payment", "cvv"),
    "local_phone": ("phone", "call", "tel", "mobile", "telefon", "téléphone", "teléfono", "fax"),
}
#: Score of a proposal by pattern alone, what a checksum and a context word add, and the least score reported.
PATTERN_SCORE, CHECKSUM_SCORE, CONTEXT_SCORE, LEAST_SCORE = 0.3, 0.4, 0.3, 0.6
#: Characters before and after a span in which context words count.
CONTEXT_REACH = 48


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check of international account numbers; letters count from 10 on."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def account_length(run: str) -> int:
    """Characters of the longest account number that run begins with and that ends with a group or with run; 0 without one."""
    for end in [len(run), *(k for k in range(len(run) - 1, 0, -1) if run[k] == " ")]:
        plain = run[:end].replace(" ", "")
        if len(plain) < 15:
            break
        if len(plain) <= 34 and mod97(plain):
            return end
    return 0


def accounts(text: str) -> Iterator[re.Match]:
    """Runs that may begin with an account number; the next one is sought behind the number, or behind the first group."""
    at = 0
    while m := _IBAN.search(text, at):
        yield m
        at = m.start() + (account_length(m[0]) or 4)


def emails(text: str) -> list[tuple[int, int]]:
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        if at >= end:
            begin = at
            while begin > end and text[begin - 1] in _LOCAL:
                begin -= 1
            domain = _DOMAIN.match(text, at) if begin < at else None
            if domain:
                out.append((begin, domain.end()))
                end = domain.end()
        at = text.find("@", at + 1)
    return out


def _ip_holds(found: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in found.split("."))


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of the four base kinds, each leftmost and without overlaps; failing matches are dropped."""
    mail = emails(text)
    ip = [m.span() for m in _IP.finditer(text) if _ip_holds(m[0])] if text.count(".") > 2 else []
    card = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NO_DIGITS.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                card.append(m.span())
    phone = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NO_DIGITS.sub("", m[0])) <= 15] if "+" in text else []
    return [mail, ip, card, phone]


def _score(text: str, kind: str, begin: int, end: int, confirmed: bool) -> float:
    near = text[max(0, begin - CONTEXT_REACH) : begin] + " " + text[end : end + CONTEXT_REACH]
    words = set(re.findall(r"[^\W\d_]+", near.lower()))
    return PATTERN_SCORE + CHECKSUM_SCORE * confirmed + CONTEXT_SCORE * bool(words.intersection(CONTEXT[kind]))


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretches that spans cover, in order; those that overlap are one."""
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((b, e))
    return out


def added_spans(text: str, base: list[list[tuple[int, int]]]) -> list[list[tuple[int, int, float]]]:
    """Spans of the added kinds, with scores; those that meet a span found before are left out."""
    taken = _joined([s for own in base for s in own])
    out: list[list[tuple[int, int, float]]] = []

    def free(begin: int, end: int) -> bool:
        at = bisect.bisect_left(taken, (end, 0))  # the last stretch that begins before end
        return not at or taken[at - 1][1] <= begin

    for kind, pattern in (("iban", _IBAN), ("social", _SOCIAL), ("short_card", _CARD), ("local_phone", _NUMBER)):
        own: list[tuple[int, int, float]] = []
        for m in accounts(text) if kind == "iban" else pattern.finditer(text):
            begin, end = m.span()
            if kind == "iban":
                end = begin + account_length(m[0])
                confirmed = end > begin
                if not confirmed:
                    continue
            elif kind == "social":
                area, group, serial = m[0].split("-")
                confirmed = area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
                if not confirmed:
                    continue
                confirmed = False  # ranges only; no checksum
            elif kind == "short_card":
                if end - begin < 13:
                    continue
                digits = _NO_DIGITS.sub("", m[0])
                confirmed = 13 <= len(digits) <= 15 and luhn(digits)
                if not confirmed:
                    continue
            else:
                confirmed = False
                if not 7 <= len(_NO_DIGITS.sub("", m[0])) <= 12:
                    continue
            score = _score(text, kind, begin, end, confirmed)
            if score >= LEAST_SCORE and free(begin, end):
                own.append((begin, end, score))
        out.append(own)
        taken = _joined(taken + [(b, e) for b, e, _ in own])
    return out


def digest(text: str | None) -> tuple:
    """(n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, max_score) of a whole text."""
    base = base_spans(text or "")
    has_digit = bool(text) and any(c in text for c in "0123456789")
    added = added_spans(text, base) if has_digit else [[]] * (len(KINDS) - 4)
    parts = [f"{KINDS[k]}:{b}:{e}" for k, own in enumerate(base) for b, e in own]
    more = [f"{KINDS[k + 4]}:{b}:{e}" for k, own in enumerate(added) for b, e, _ in sorted(own)]
    scores = [s for own in added for _, _, s in own]
    top = 1.0 if parts else max(scores, default=0.0)
    return (*map(len, base), hashlib.sha256(",".join(parts).encode()).hexdigest(), ",".join(parts + more), len(more), top)


_NAMES = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "max_score")
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64())


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, max_score) for each row of docs.

    spans lists kind:start:end (code points, end exclusive) by kind, then start. Null and empty texts have no
    spans. Repeated rows each give a row; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = list(zip(*map(digest, batch.column("text").to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")] + [pa.array(r, t) for r, t in zip(rows, _TYPES, strict=True)], names=["doc_id", *_NAMES])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, max_score double"
    )
