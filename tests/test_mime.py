"""Golden messages for the parsers."""

from __future__ import annotations

import base64

from hypothesis import given, settings
from hypothesis import strategies as st

from sieve.operators import mime


def message() -> bytes:
    subject = "=?utf-8?B?" + base64.b64encode("Тест".encode()).decode() + "?="
    return "\r\n".join(
        [
            f"Subject: {subject}", "From: A <a@example.com>", 'Content-Type: multipart/mixed; boundary="b"', "",
            "--b", "Content-Type: text/html; charset=utf-8", "Content-Transfer-Encoding: quoted-printable", "",
            "<p>Hello=20<b>you</b> https://example.com/x</p><script>no()</script>",
            "--b", 'Content-Type: application/octet-stream; name="x.bin"', "Content-Disposition: attachment", "Content-Transfer-Encoding: base64", "", "AAEC",
            "--b--", "",
        ]
    ).encode()


def test_multipart_message():
    m = mime.parse_message(message())
    assert m["subject"] == "Тест"
    assert "example.com" in m["from"]
    assert m["has_html"] and m["attachment_count"] == 1 and m["url_count"] == 1
    assert "Hello" in m["text"] and "no()" not in m["text"]
    assert m["raw_length"] == len(message())


def test_headers_fold_merge_and_end():
    h = mime.read_headers(b"A: 1\r\n  2\r\nb: x\r\nB: y\r\nbroken line\r\n folded onto nothing\r\n: none\r\n")
    assert dict(h) == {"a": "1 2", "b": "x, y"}


def test_transfer_decoding_keeps_what_is_malformed():
    assert mime.decode_transfer(b"not base64!", "base64") == b"not base64!"
    assert mime.decode_transfer(b"a=\r\nb=3D=ZZ=", "Quoted-Printable") == b"ab==ZZ="


def test_charsets_and_words():
    assert mime.decode_charset(b"\xe9", "cp1252") == "é"
    assert mime.decode_charset(b"\xff", "unknown") == "�"
    assert mime.decode_words("=?utf-8?Q?a_b=21?= =?utf-8?B?!?=") == "a b! =?utf-8?B?!?="


def test_bodies_without_headers_and_nesting():
    assert mime.parse_message(b"just a header line")["text"] == ""
    nested = b"Content-Type: message/rfc822\n\nSubject: in\n\ninner text"
    assert mime.parse_message(nested)["text"] == "inner text"
    assert mime.parse_message(b"Content-Type: multipart/mixed\n\n--b\n\nx")["text"] == ""


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=400))
def test_any_bytes_parse(raw):
    assert mime.parse_message(raw)["raw_length"] == len(raw)
    assert isinstance(mime.parse_stdlib(raw)["document"], str)


def test_udf_gives_the_same(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(bytearray(message()),)], "raw binary").select(mime.parse_udf("raw").alias("m")).select("m.*").first()
    assert row["subject"] == "Тест" and row["headers"]["from"] == "A <a@example.com>" and row["url_count"] == 1
    neutral = spark.range(1).select(mime.render_message(F.lit("a@b.cc"), F.lit("d@e.ff"), F.lit("hi\nX-Evil: 1"), F.lit("body")).alias("raw"))
    m = mime.parse_message(bytes(neutral.first()["raw"]))
    assert m["subject"] == "hi X-Evil: 1" and m["text"] == "body"
