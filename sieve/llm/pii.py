"""PII: patterns propose spans, checksums confirm them, words nearby change the score.

Each span has a score from 0 to 1: its pattern's own, more for a valid checksum or structure, more for a word near the span that
belongs to its kind, less for one that speaks against it. Kinds email, ip, card and phone are found by fixed patterns
and rules and stay whatever their score. The method adds spans of kind ``iban`` (mod-97), ``id`` (nine-digit
social numbers such as 123-45-6789) and ``secret`` (access keys and tokens by their known forms, private-key blocks, and long random strings),
which need a score of ``threshold``.

Whole texts are searched, in place: no shuffle. Spans are in code points, end exclusive.

Defined cases: a null text counts as empty and has no spans; a text of any length is searched whole, in time that grows with
its length; spans of a kind don't overlap, those of two kinds may; spans are ordered by start, then kind as listed, then end; an empty
table gives an empty result; repeated rows each get their spans. Other columns of the input are not looked at, whatever
their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.llm.common import lean, ship, text_of

# Kinds in their order, base patterns, and words that speak for or against a kind.
KINDS = ("email", "ip", "card", "phone", "iban", "id", "secret")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LONG = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}(?:={1,2})?(?![A-Za-z0-9+/_=-])"
KEY_BLOCK = r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[^-]*-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----"
FORMS = r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}"
HEX = r"[0-9a-f]+|[0-9A-F]+"
WORDS_FOR = {
    "email": ("email", "mail", "contact", "write", "reply"),
    "ip": ("ip", "host", "server", "address", "client", "login"),
    "card": ("card", "visa", "credit", "debit", "payment", "expires"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "id": ("ssn", "social", "security", "identity", "tax"),
    "secret": ("token", "secret", "key", "apikey", "password", "passwd", "credential", "credentials", "auth", "authorization", "bearer"),
}
WORDS_AGAINST = {
    "ip": ("version", "release", "section"),
    "secret": ("sha", "md", "hash", "checksum", "digest", "commit", "revision", "fingerprint", "etag"),
    "": ("order", "part", "serial", "version", "invoice", "model"),
}
OWN = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6}  # scores of base kinds before context

# A match can only begin where a run of its first characters does, or where the match before it ended: looking
# there alone finds the same spans and keeps long runs linear.
_email, _email_here = re.compile(rf"(?<![A-Za-z0-9._%+-]){EMAIL}"), re.compile(EMAIL)
_ip = re.compile(rf"(?<![0-9]){IP}")
_card, _phone, _iban, _social = (re.compile(x) for x in (CARD, PHONE, IBAN, SOCIAL))
_long, _block, _form, _hex, _word = (re.compile(x) for x in (LONG, KEY_BLOCK, FORMS, HEX, r"[^\W\d_]+"))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the base kinds, in order."""
    out: list[tuple[int, int, str]] = []
    if "@" in text:
        m = _email.search(text)
        while m:
            out.append((m.start(), m.end(), "email"))
            m = _email_here.match(text, m.end()) or _email.search(text, m.end())
    for m in _ip.finditer(text):
        # A part of over three digits may still be small: leading zeros.
        if all((p := part.lstrip("0")) == "" or len(p) <= 3 and int(p) <= 255 for part in m.group().split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _card.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _phone.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), m.end(), "phone"))
    out.sort(key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return out


def _context(text: str, start: int, end: int, kind: str, window: int) -> float:
    words = {w.lower() for w in _word.findall(text[max(0, start - window) : start] + " " + text[end : end + window])}
    against = WORDS_AGAINST.get(kind, WORDS_AGAINST[""])
    return 0.25 * any(w in words for w in WORDS_FOR[kind]) - 0.35 * any(w in words for w in against)


def _random(value: str) -> float:
    """How much a long string looks drawn at random: by the entropy of its characters and by mixing letters with digits."""
    n = len(value)
    if not any(c.isdigit() for c in value) or not any(c.isalpha() for c in value):
        return 0.0
    bits = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    return 1.0 if bits >= (3.0 if _hex.fullmatch(value) else 3.7) else 0.0


def added_spans(text: str, threshold: float = 0.6, window: int = 40) -> list[tuple[int, int, str, float]]:
    """Spans (start, end, kind, score) of the kinds that the method adds."""
    out = []

    def add(a: int, b: int, kind: str, own: float) -> None:
        score = own + _context(text, a, b, kind, window)
        if score >= threshold:
            out.append((a, b, kind, min(1.0, score)))

    for m in _iban.finditer(text):
        add(m.start(), m.end(), "iban", 0.3 + 0.5 * mod97(m.group().replace(" ", "")))
    for m in _social.finditer(text):
        area, group, serial = m.group().split("-")
        valid = area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
        add(m.start(), m.end(), "id", 0.2 + 0.3 * valid)
    blocks = [m.span() for m in _block.finditer(text)] if "PRIVATE KEY-----" in text else []
    out += [(a, b, "secret", 1.0) for a, b in blocks]
    for m in _long.finditer(text):
        a, b = m.span()
        if any(x < b and a < y for x, y in blocks):
            continue
        value = m.group().rstrip("=")
        if _form.fullmatch(value):
            out.append((a, b, "secret", 0.95))
        elif _random(value):
            add(a, b, "secret", 0.4)
    return out


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def scored_spans(text: str, threshold: float = 0.6, window: int = 40) -> list[tuple[int, int, str, float]]:
    """All spans (start, end, kind, score) in order; base kinds stay whatever their score."""
    base = [(a, b, kind, min(1.0, max(0.0, OWN[kind] + _context(text, a, b, kind, window)))) for a, b, kind in base_spans(text)]
    return sorted(base + added_spans(text, threshold, window), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def all_spans(text: str, threshold: float = 0.6, window: int = 40) -> list[tuple[int, int, str]]:
    return [s[:3] for s in scored_spans(text, threshold, window)]


def _search(threshold: float, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b, "score": s} for a, b, k, s in scored_spans(t.as_py(), threshold, window)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, SPANS)], ["id", "spans"])

    return lean(run)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.6, window: int = 40) -> DataFrame:
    """id and ``spans``: all spans of the text, as an array of structs (kind, start, end, score) in order."""
    ship(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    found = base.mapInArrow(_search(threshold, window), f"id {kind}, spans array<struct<kind:string,start:long,end:long,score:double>>")
    return found.withColumnRenamed("id", id_col)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.6, window: int = 40) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in brackets; other columns as they are."""
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def cut_out(texts):
        out = []
        for text in texts:
            if text is None:
                out.append(None)
                continue
            at, parts = 0, []
            for a, b, kind in sorted(all_spans(text, threshold, window), key=lambda s: (s[0], -s[1])):
                if a >= at:
                    parts += [text[at:a], f"[{kind}]"]
                at = max(at, b)
            out.append("".join([*parts, text[at:]]))
        import pandas as pd

        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, cut_out(F.col(text_col)))
