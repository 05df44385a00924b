"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in the whole text: at-signs, plus signs, digits, schemes
and words that announce an account or a secret. From each anchor a small deterministic parser
expands to the boundaries of what it may be (an email, an address, a card or phone number, an
account) and validates it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import bound_batches, kind, valid

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "url", "account", "secret"]
#: Words before an account number, and before a secret, in English, German, French and Spanish.
ACCOUNT_CUES = [
    "account", "acct", "iban", "swift", "bic", "routing", "sort code", "passport", "ssn", "social security", "tax id", "driver license", "licence no", "customer", "member", "patient", "policy", "student id", "employee id",
    "konto", "kontonummer", "steuernummer", "steuer-id", "reisepass", "ausweis", "kundennummer", "versicherungsnummer", "compte", "passeport", "carte d'identité", "numéro fiscal", "sécurité sociale", "cuenta", "pasaporte", "dni", "nie", "nif", "número de cliente",
]
SECRET_CUES = [
    "api_key", "api-key", "apikey", "api key", "access_key", "access key", "secret_key", "secret", "client_secret", "private_key", "private key", "auth_token", "access_token", "refresh_token", "token", "bearer", "passwd", "password", "passphrase", "pwd", "pin code", "credential",
    "passwort", "kennwort", "zugangscode", "mot de passe", "clé", "contraseña", "clave",
]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"://[^\s<>\"'`|\\^{}]+")
_VALUE = re.compile(r"s?(?:[ \t]+(?:number|no\.?|code))?[ \t]*[=:#][ \t]*[\"']?([A-Za-z0-9+/_.~-]{6,})")
_IBAN = re.compile(r"[ \t:=#]*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban(value: str) -> bool:
    turned = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def automaton():
    import ahocorasick

    made = ahocorasick.Automaton()
    for c in "0123456789":
        made.add_word(c, ("digit", 1))
    made.add_word("@", ("at", 1))
    made.add_word("+", ("plus", 1))
    made.add_word("://", ("scheme", 3))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.title(), cue.upper()}:
                made.add_word(form, (kind, len(cue)))
    made.make_automaton()
    return made


def find(text: str, anchors) -> list[tuple[int, int, int]]:
    """Spans (start, place of the kind in ``KINDS``, end) of one text, in order.

    For the kinds of ``BASE`` these are the leftmost non-overlapping matches of their patterns that
    validate; a match that doesn't validate is passed over as a whole.
    """
    spans: set[tuple[int, int, int]] = set()
    after_email = after_ip = after_card = after_phone = after_url = 0
    for end, (kind, width) in anchors.iter(text):
        at = end - width + 1
        if kind == "digit":
            if at >= after_card:
                m = _CARD.match(text, at)
                after_card = m.end() if m else at + 1
                if m and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                    spans.add((at, 2, m.end()))
            if at >= after_ip:
                m = _IP.match(text, at)
                after_ip = m.end() if m else _DIGITS.match(text, at).end()
                if m and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups()):
                    spans.add((at, 1, m.end()))
        elif kind == "at":
            start = at
            while start > after_email and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                spans.add((start, 0, m.end()))
                after_email = m.end()
        elif kind == "plus":
            if at >= after_phone and (m := _PHONE.match(text, at)):
                after_phone = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans.add((at, 3, m.end()))
        elif kind == "scheme":
            start = at
            while start > after_url and text[start - 1] in _SCHEME:
                start -= 1
            while start < at and not text[start].isalpha():
                start += 1
            m = _URL.match(text, at)
            if start < at and m and (stop := at + len(m[0].rstrip(".,;:!?)]"))) > at + 3:
                spans.add((start, 4, stop))
                after_url = m.end()
        else:
            if kind == "account" and (m := _IBAN.match(text, end + 1)):
                value = m[1].replace(" ", "")
                if len(value) <= 34 and iban(value):
                    spans.add((m.start(1), 5, m.end(1)))
                    continue
            if m := _VALUE.match(text, end + 1):
                value = m[1].rstrip(".")
                if len(value) >= 6 and any(c.isdigit() for c in value):
                    spans.add((m.start(1), KINDS.index(kind), m.start(1) + len(value)))
    return sorted(spans)


_anchors: list = []
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _anchors:
        _anchors.append(automaton())
    for batch in batches:
        found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find(t, _anchors[0])] if t else [] for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, _SPAN)], names=["id", "spans"])


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for every row; spans (kind, start, end) by start and then by kind, in code points.

    A null or empty text has no spans; repeated rows and null ids, of any type, are scanned like others, very long
    texts whole. Broken UTF-8 counts as U+FFFD. An empty table gives no rows. Columns other than the two named aren't read.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), valid(F.col(text_col)).alias("text"))
    found = rows.mapInArrow(_scan, f"id {kind(rows, 'id')}, spans array<struct<kind:string,start:long,end:long>>")
    return found.withColumnRenamed("id", id_col)


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
