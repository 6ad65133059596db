"""Personal data by anchor expansion.

One Aho-Corasick pass finds the characters and cues every kind of span must contain: at-signs, plus signs,
digits, schemes, account and secret cues. A small deterministic parser per kind then expands from the
anchor to the boundaries of the span and validates it. Spans of one kind never overlap; a parser resumes
behind its last match, as a search from left to right would.
"""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from crossmarket.llm.common import id_type, keeps, keyed, reachable

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"']+")
_ACCOUNT = re.compile(r"(?:[ \t]*(?:number|no\.?|nr\.?|#))?[ \t]*[:=#]?[ \t]*"
                      r"([A-Za-z]{0,2}[0-9][A-Za-z0-9]*(?:[ -](?=[A-Za-z]*[0-9])[A-Za-z0-9]+)*)", re.I)
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[ -]?[A-Za-z0-9]){11,30}")
_GROUP = re.compile(r"[A-Za-z0-9]+")
_SECRET = re.compile(r"[ \t]*[:=][ \t]*[\"']?([A-Za-z0-9_/+=.-]{8,})")
_KEY_ID = re.compile(r"AKIA[A-Z0-9]{16}")

_SCHEMES = ("http://", "https://", "ftp://")
_ACCOUNT_CUES = ("iban", "account", "acct", "konto", "compte", "cuenta")
_SECRET_CUES = ("password", "passwd", "token", "secret", "api_key", "apikey", "api key")


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick
    cues = [("@", "email"), ("+", "phone"), ("akia", "key")]
    cues += [(d, "digit") for d in "0123456789"] + [(s, "url") for s in _SCHEMES]
    cues += [(c, "account") for c in _ACCOUNT_CUES] + [(c, "secret") for c in _SECRET_CUES]
    automaton = ahocorasick.Automaton()
    for cue, kind in cues:
        automaton.add_word(cue, (kind, len(cue)))
    automaton.make_automaton()
    return automaton


def _lower(text: str) -> str:
    """Lower-cased without moving any character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _account_end(text: str, start: int, end: int) -> int:
    """Where the account number ends: an IBAN where its check holds, others with their last group that has a
    digit, at most 34 digits in all; 0 if it has under six digits."""
    if iban := _IBAN.match(text, start):
        for group in reversed([*_GROUP.finditer(text, start, iban.end())]):
            plain = text[start:group.end()].replace(" ", "").replace("-", "")
            whole = not text[group.end():group.end() + 1].isalnum()
            if whole and len(plain) >= 15 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
                return group.end()
    digits = stop = 0
    for group in _GROUP.finditer(text, start, end):
        more = sum(c.isdigit() for c in group[0])
        if digits + more > 34:
            break
        digits, stop = digits + more, group.end()
    return stop if digits >= 6 else 0


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """(start, end) in code points, by kind, in order."""
    spans: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    behind = dict.fromkeys((*KINDS, "digits"), 0)

    def email(at: int) -> None:
        start, left = at, behind["email"]
        while start > left and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at + 1)):
            spans["email"].append((start, found.end()))
            behind["email"] = found.end()

    def ip(at: int) -> None:
        if found := _IP.match(text, at):
            if all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in found[0].split(".")):
                spans["ip"].append(found.span())
            behind["ip"] = found.end()
        else:
            behind["ip"] = _DIGITS.match(text, at).end()

    def card(at: int) -> None:
        if found := _CARD.match(text, at):
            digits = found[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                spans["card"].append(found.span())
            behind["card"] = found.end()

    def phone(at: int) -> None:
        if found := _PHONE.match(text, at):
            if 8 <= sum(c.isdigit() for c in found[0]) <= 15:
                spans["phone"].append(found.span())
            behind["phone"] = found.end()

    def account(end: int) -> None:
        if (found := _ACCOUNT.match(text, end)) and found.start(1) >= behind["account"]:
            if stop := _account_end(text, *found.span(1)):
                spans["account"].append((found.start(1), stop))
                behind["account"] = stop

    def secret(end: int) -> None:
        if (found := _SECRET.match(text, end)) and found.start(1) >= behind["secret"] and any(c.isdigit() for c in found[1]):
            spans["secret"].append(found.span(1))
            behind["secret"] = found.end(1)

    for last, (kind, size) in _automaton().iter(_lower(text)):
        at, end = last + 1 - size, last + 1
        if kind == "digit":
            if at >= behind["ip"]:
                ip(at)
            if at >= behind["card"]:
                card(at)
        elif kind == "email":
            if at >= behind["email"]:
                email(at)
        elif kind == "phone":
            if at >= behind["phone"]:
                phone(at)
        elif kind == "url":
            if at >= behind["url"] and (found := _URL.match(text, end)):
                stop = end + len(found[0].rstrip(".,;:!?)"))
                if stop > end:
                    spans["url"].append((at, stop))
                    behind["url"] = stop
        elif kind == "account":
            account(end)
        elif kind == "secret":
            secret(end)
        elif at >= behind["secret"] and (found := _KEY_ID.match(text, at)):
            spans["secret"].append(found.span())
            behind["secret"] = found.end()
    return spans


def _listed(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind in kinds for start, end in spans[kind])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_extra.

    The first four kinds are counted and hashed; `spans` also lists the kinds the cues add (url, account,
    secret). A missing or empty text has no spans; repeated rows each give a row.
    """
    rows = keyed(docs, id_col, text_col)

    def find(batches):
        keeps("pii", _automaton.cache_clear)
        for batch in batches:
            found = [find_spans(text) for text in batch.column("text").to_pylist()]
            counts = [pa.array([len(s[kind]) for s in found], pa.int64()) for kind in BASE]
            hashes = [sha256(_listed(s, BASE).encode()).hexdigest() for s in found]
            extra = [sum(len(s[kind]) for kind in KINDS[len(BASE):]) for s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(hashes, pa.string()),
                 pa.array([_listed(s, KINDS) for s in found], pa.string()), pa.array(extra, pa.int64())],
                ["doc_id", *(f"n_{kind}" for kind in BASE), "base_sha256", "spans", "n_extra"])

    reachable(docs.sparkSession)
    return rows.mapInArrow(find, f"doc_id {id_type(rows)}, n_email bigint, n_ip bigint, n_card bigint, "
                                 "n_phone bigint, base_sha256 string, spans string, n_extra bigint")


def redacted_text(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans count as the first of them."""
    if not text:
        return text
    spans = sorted((start, -end, kind) for kind, found in find_spans(text).items() for start, end in found)
    parts, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, -end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with personal data in the text replaced; missing texts stay missing."""
    def replace(batches):
        keeps("pii", _automaton.cache_clear)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            changed = pa.array([redacted_text(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(
                [changed if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    reachable(docs.sparkSession)
    return docs.mapInArrow(replace, docs.schema)
