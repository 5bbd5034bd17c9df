"""Messages to rows: a strict parser with fixed rules, and one on the standard library's parser; both as Arrow UDFs.

``parse_message`` is plain Python over bytes, so it can be tested and used without Spark.
"""

from __future__ import annotations

import base64
import binascii
import email
import email.policy
import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieve.functions import text as X
from sieve.schema import PARSED

ENCODED_WORD = re.compile(r"=\?([^?\s]+)\?([bBqQ])\?([^?]*)\?=")
BOUNDARY = re.compile(r"boundary\s*=\s*(?:\"([^\"]+)\"|([^;\s]+))", re.I)
CHARSET = re.compile(r"charset\s*=\s*(?:\"([^\"]+)\"|([^;\s]+))", re.I)
SCRIPTS = re.compile(r"<(script|style)\b[^>]*>.*?</\1>", re.I | re.S)
TAGS = re.compile(r"<[^>]+>", re.S)
URLS = re.compile(r"https?://[^\s<>'\"]+", re.I)
ESCAPES = re.compile(rb"=(\r?\n|[0-9A-Fa-f]{2})")
MOST_DEPTH = 20
# Charset names that aren't read as UTF-8.
LATIN = {"iso-8859-1", "latin1", "latin-1", "windows-1252", "cp1252"}
ASCII = {"us-ascii", "ascii"}


class Headers(dict):
    """Header values by lower-cased name."""

    def value(self, name: str) -> str:
        return self.get(name.lower(), "")


def split_entity(raw: bytes) -> tuple[bytes, bytes]:
    """Headers and body: at the first empty CRLF line, else the first empty LF line; without either all is header."""
    for mark in (b"\r\n\r\n", b"\n\n"):
        head, found, body = raw.partition(mark)
        if found:
            return head, body
    return raw, b""


def read_headers(block: bytes) -> Headers:
    """Folded lines joined by a space, repeated names by a comma; a line without a name ends the header before it."""
    out = Headers()
    fields: list[list[str]] = []
    open_ = False
    for line in re.split(r"\r\n|\r|\n", block.decode("latin-1")):
        if line[:1] in (" ", "\t") and line and open_:
            fields[-1].append(line.strip())
            continue
        name, colon, value = line.partition(":")
        open_ = bool(colon and name)
        if open_:
            fields.append([name.strip(), value.strip()])
    for name, *values in fields:
        if name:
            value = " ".join(values).strip()
            key = name.lower()
            out[key] = f"{out[key]}, {value}" if key in out else value
    return out


def quoted_printable(data: bytes) -> bytes:
    """Soft line ends removed, escapes decoded, anything malformed kept."""
    return ESCAPES.sub(lambda m: b"" if m[1][-1:] == b"\n" else bytes([int(m[1], 16)]), data)


def strict_base64(data: str) -> bytes:
    return base64.b64decode(data, validate=True)


def decode_transfer(body: bytes, encoding: str) -> bytes:
    encoding = encoding.strip().lower()
    if encoding == "base64":
        try:
            return strict_base64(re.sub(r"\s+", "", body.decode("latin-1")))
        except (binascii.Error, ValueError):
            return body
    return quoted_printable(body) if encoding == "quoted-printable" else body


def decode_charset(data: bytes, charset: str | None) -> str:
    name = (charset or "").strip().strip('"').lower()
    if name in LATIN:
        return data.decode("latin-1")
    if name in ASCII:
        return "".join(chr(b) if b < 128 else "?" for b in data)
    return data.decode("utf-8", "replace")


def decode_words(value: str) -> str:
    """Encoded words decoded one by one; one that can't be is left as it is."""

    def word(m: re.Match) -> str:
        try:
            data = strict_base64(m[3]) if m[2] in "bB" else quoted_printable(m[3].replace("_", " ").encode("latin-1"))
        except (binascii.Error, ValueError):
            return m[0]
        return decode_charset(data, m[1])

    return ENCODED_WORD.sub(word, value) if value.strip() else ""


def html_text(source: str) -> str:
    return html.unescape(TAGS.sub(" ", SCRIPTS.sub(" ", source)))


def tidy(text: str) -> str:
    text = re.sub(r"[\t ]+", " ", text.replace("\r\n", "\n").replace("\r", "\n"))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def _parameter(pattern: re.Pattern, value: str) -> str:
    m = pattern.search(value)
    return (m[1] or m[2]) if m else ""


def looks_attached(kind: str, disposition: str) -> bool:
    disposition = disposition.lower()
    return "attachment" in disposition or "filename=" in disposition or "name=" in kind.lower()


def multipart(body: bytes, boundary: str) -> list[bytes]:
    """The chunks between boundary marks, wherever those stand, up to one that begins with --."""
    out = []
    for chunk in body.split(b"--" + boundary.encode("latin-1", "replace"))[1:]:
        if chunk.startswith(b"--"):
            break
        if chunk := chunk.strip(b"\r\n"):
            out.append(chunk)
    return out


def parse_message(raw: bytes) -> dict:
    """A message as the fields of schema.PARSED."""
    head, body = split_entity(raw)
    headers = read_headers(head)
    texts: list[str] = []
    attachments, has_html = 0, False
    waiting = [(headers, body, 0)]
    while waiting:
        own, data, depth = waiting.pop()
        if depth > MOST_DEPTH:
            continue
        kind, encoding = own.value("content-type"), own.value("content-transfer-encoding")
        attachments += looks_attached(kind, own.value("content-disposition"))
        low = kind.lower()
        if low.startswith("multipart/"):
            if (boundary := _parameter(BOUNDARY, kind)).strip():
                parts = [split_entity(p) for p in multipart(data, boundary)]
                waiting += [(read_headers(h), b, depth + 1) for h, b in reversed(parts)]
        elif low.startswith("message/rfc822"):
            h, b = split_entity(decode_transfer(data, encoding))
            waiting.append((read_headers(h), b, depth + 1))
        elif not kind.strip() or low.startswith("text/"):
            text = decode_charset(decode_transfer(data, encoding), _parameter(CHARSET, kind))
            if low.startswith("text/html"):
                has_html, text = True, html_text(text)
            if text.strip():
                texts.append(text)
    text = tidy("\n".join(texts))
    return {
        "subject": decode_words(headers.value("subject")),
        "from": decode_words(headers.value("from")),
        "to": decode_words(headers.value("to")),
        "text": text,
        "headers": dict(headers),
        "url_count": len(URLS.findall(text)),
        "attachment_count": attachments,
        "has_html": has_html,
        "raw_length": len(raw),
    }


def parse_stdlib(raw: bytes, most: int = 250_000, attached: bool = True, prefix: tuple[str, ...] = ("subject", "from", "to")) -> dict:
    """A document by the standard library's parser: named headers, then all text parts, capped; unreadable messages as UTF-8."""
    try:
        message = email.message_from_bytes(raw, policy=email.policy.compat32)
        parts = [f"{p} {decode_words(str(message.get(p) or ''))}" for p in prefix]
        count = 0
        for part in message.walk():
            if part.get_content_disposition() == "attachment":
                count += 1
                if not attached:
                    continue
            if part.get_content_maintype() == "text":
                data = part.get_payload(decode=True) or b""
                text = decode_charset(data, part.get_content_charset())
                parts.append(html_text(text) if part.get_content_subtype() == "html" else text)
        return {"document": "\n".join(parts)[:most], "attachments": count}
    except (LookupError, ValueError, TypeError):
        return {"document": raw.decode("utf-8", "replace")[:most], "attachments": 0}


@F.pandas_udf(PARSED)
def parse_udf(raws: pd.Series) -> pd.DataFrame:
    rows = [parse_message(bytes(r) if r is not None else b"") for r in raws]
    return pd.DataFrame(rows, columns=[f.name for f in PARSED.fields])


@F.pandas_udf(T.StructType([T.StructField("document", T.StringType()), T.StructField("attachments", T.IntegerType())]))
def document_udf(raws: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_stdlib(bytes(r) if r is not None else b"") for r in raws], columns=["document", "attachments"])


def render_message(sender: Column, receiver: Column, subject: Column, body: Column, date: Column | None = None) -> Column:
    """A source-neutral message of a row, as bytes: nothing of a row's source or label gets into it."""
    line = lambda name, c: F.concat(F.lit(name + ": "), X.stable_clean(F.coalesce(c, F.lit(""))))
    head = [line("From", sender), line("To", receiver), line("Subject", subject)] + ([line("Date", date)] if date is not None else [])
    head.append(F.lit("Content-Type: text/plain; charset=utf-8"))
    return F.encode(F.concat_ws("\r\n", *head, F.lit(""), F.coalesce(body, F.lit(""))), "UTF-8")


def identity(parsed: str = "m") -> list[Column]:
    """Sender, domains, subject, network and hosts of a parsed message, as named columns."""
    m = F.col(parsed)
    h = lambda name: F.coalesce(F.try_element_at(m["headers"], F.lit(name)), F.lit(""))
    return [
        F.lower(F.regexp_extract(m["from"], r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)", 1)).alias("sender"),
        X.address_domain(m["from"]).alias("sender_domain"),
        X.address_domain(h("return-path")).alias("return_domain"),
        X.address_domain(h("message-id")).alias("message_id_domain"),
        X.public_slash24(h("received")).alias("ip24"),
        X.normalise_subject(m["subject"]).alias("subject_key"),
        X.sorted_distinct(X.url_hosts(m["text"], 1000), 20).alias("url_domains"),
    ]


def authentication_flags(symbols: Column) -> list[Column]:
    """Results of sender authentication, from names of a scan's symbols."""
    has = lambda *parts: F.exists(symbols, lambda s: F.upper(s["name"]).rlike("|".join(parts))).cast("int")
    return [
        has("DKIM.*ALLOW", "DKIM_VALID").alias("dkim_pass"),
        has("DKIM.*REJECT", "DKIM_INVALID").alias("dkim_bad"),
        has("SPF_ALLOW", "SPF_PASS").alias("spf_pass"),
        has("SPF_FAIL", "SPF_SOFTFAIL").alias("spf_bad"),
        has("DMARC.*REJECT", "DMARC.*QUARANTINE", "DMARC_FAIL").alias("dmarc_bad"),
    ]


def canonical(subject: Column, text: Column, most: int = 120_000) -> list[Column]:
    """The canonical document of a message: identity, windows for two encoders, and its masked text."""
    clean = lambda c: X.collapse(F.replace(X.unescape_html(X.nfkc(F.coalesce(c, F.lit("")))), F.lit("\0"), F.lit(" ")))
    s, t = clean(subject), F.substring(clean(text), 1, most)
    both = F.concat_ws("\n", s, t)
    head, tail = X.head_tail(both)
    return [
        head.alias("semantic_head"),
        tail.alias("semantic_tail"),
        X.mask_entities(F.substring(both, 1, 5000)).alias("ngram_text"),
        F.sha2(X.casefold(both), 256).alias("identity"),
        X.sorted_distinct(X.url_hosts(t, 1000), 24).alias("hosts"),
    ]
