"""Text functions. Java's regular expressions need (?U) or \\p classes to see Unicode letters as the contracts do."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Token patterns.
TOKEN = r"[\p{L}\p{Nd}][\p{L}\p{Nd}_\-.@]{1,48}"
TOKEN_PATTERNS = {
    "features": TOKEN,
    "words2": r"[\p{L}\p{N}_@.\-]{2,}",
    "words2_48": r"[\p{L}\p{N}_@.\-]{2,48}",
    "words3": r"[\p{L}\p{N}_@.\-]{3,}",
}
DOMAIN = r"@([A-Za-z0-9.-]+\.[A-Za-z]{2,})"
URL = r"(?i)https?://[^\s<>'\"]+"
URL_HOST = r"(?i)https?://([^/\s:]+)"
CUES = {
    "urgent": r"\b(?:urgent|immediately|asap)\b",
    "verify": r"\b(?:verify|confirm|validate)\b",
    "account": r"\baccount\b",
    "password": r"\b(?:password|passcode|pin)\b",
    "payment": r"\b(?:payment|invoice|wire|transfer)\b",
    "prize": r"\b(?:prize|winner|won|lottery)\b",
    "click": r"\bclick\b",
    "suspend": r"\b(?:suspend|suspended|locked|limited)\b",
}


def collapse(c: Column) -> Column:
    """White space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fingerprint_text(c: Column) -> Column:
    """Lower case, URLs and numbers of two or more digits replaced, white space collapsed."""
    c = F.regexp_replace(F.lower(c), r"https?://\S+", " <url> ")
    c = F.regexp_replace(c, r"(?U)\b\d{2,}\b", " <num> ")
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def tokens(c: Column, pattern: str = TOKEN, most: int | None = None) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))
    return F.slice(found, 1, most) if most else found


def bigrams(words: Column, most: int | None = None, joint: str = "_") -> Column:
    """Neighbouring tokens, joined; none for fewer than two."""
    # zip_with sees each side once; a lambda over places would evaluate ``words`` again for each of them.
    n = F.greatest(F.size(words) - 1, F.lit(0))
    n = F.least(n, F.lit(most)) if most else n
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(joint), b))


def bound(value: Column, use) -> Column:
    """use(value) with the value evaluated once, however often its result is used inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalise_lines(c: Column) -> Column:
    """CR and CRLF to LF, blanks collapsed, at most one empty line, trimmed."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[\t ]+", " ")
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def strip_html(c: Column) -> Column:
    """Scripts and styles dropped, tags replaced by spaces; character references are left as they are."""
    c = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    return F.regexp_replace(c, r"(?s)<[^>]+>", " ")


@F.pandas_udf(T.StringType())
def unescape_html(texts: pd.Series) -> pd.Series:
    """Character references decoded; Spark has no built-in for it."""
    return texts.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def casefold(texts: pd.Series) -> pd.Series:
    return texts.map(str.casefold, na_action="ignore")


def html_to_text(c: Column) -> Column:
    return normalise_lines(unescape_html(strip_html(c)))


def url_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(URL))


def url_hosts(c: Column, most: int = 25) -> Column:
    """Lower-cased hosts of the URLs in a text, in order, repeats included."""
    return F.transform(F.slice(F.regexp_extract_all(c, F.lit(URL_HOST), F.lit(1)), 1, most), F.lower)


def address_domain(c: Column) -> Column:
    """The domain of the first address in a text, or the empty string."""
    return F.lower(F.regexp_extract(c, DOMAIN, 1))


def host_of(url: Column) -> Column:
    """The host of one URL: trailing punctuation off, www. read as http, lower case, no outer dots; errors give ''."""
    c = F.regexp_replace(url, r"[.,);\]>]+$", "")
    c = F.when(F.lower(c).startswith("www."), F.concat(F.lit("http://"), c)).otherwise(c)
    return F.coalesce(F.trim(F.lower(F.try_parse_url(c, F.lit("HOST"))), F.lit(".")), F.lit(""))


def normalise_category(c: Column) -> Column:
    """Lower case, anything but letters and digits to _, outer _ off; blank gives 'none'."""
    safe = F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]", "_")
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "none").otherwise(F.trim(safe, F.lit("_")))


def normalise_option(c: Column) -> Column:
    """Lower case, digit runs to #, other runs to _, at most 80 characters; blank gives ''."""
    safe = F.regexp_replace(F.regexp_replace(F.lower(c), r"\d+", "#"), r"[^a-zа-яё0-9_.:@#-]+", "_")
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "").otherwise(F.substring(safe, 1, 80))


def normalise_subject(c: Column) -> Column:
    """URLs, long hexadecimal strings and numbers to placeholders, punctuation to spaces, at most 240 characters."""
    c = F.regexp_replace(F.lower(c), r"https?://\S+", " urltoken ")
    c = F.regexp_replace(c, r"\b[0-9a-f]{8,}\b", " hextoken ")
    c = F.regexp_replace(c, r"\d+", " num ")
    return F.substring(collapse(F.regexp_replace(c, r"[^\p{L}\p{N}\s]+", " ")), 1, 240)


def stable_clean(c: Column, most: int = 1000) -> Column:
    """Line ends and NULs to spaces, white space collapsed, capped."""
    return F.substring(collapse(F.regexp_replace(c, r"[\r\n\x00]", " ")), 1, most)


def mask_entities(c: Column) -> Column:
    """E-mail addresses, URLs and numbers of three or more digits to placeholders."""
    c = F.regexp_replace(c, r"(?i)(?:https?://|www\.)[^\s<>'\"]+", " urltoken ")
    c = F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", " emailtoken ")
    return collapse(F.regexp_replace(c, r"\d{3,}", " numtoken "))


def head_tail(c: Column, head: int = 2400, tail: int = 1600) -> tuple[Column, Column]:
    return F.substring(c, 1, head), F.right(c, F.lit(tail))


def sorted_distinct(c: Column, most: int) -> Column:
    return F.slice(F.array_sort(F.array_distinct(c)), 1, most)


def public_slash24(c: Column) -> Column:
    """The /24 of the first dotted quad that is public, or ''."""
    quads = F.regexp_extract_all(c, F.lit(r"(?<![0-9.])([0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9.])"), F.lit(1))

    def public(q: Column) -> Column:
        part = F.transform(F.split(q, r"\."), lambda x: x.cast("int"))
        a, b = part[0], part[1]
        inside = F.forall(part, lambda x: x <= 255)
        private = (a == 10) | (a == 127) | ((a == 192) & (b == 168)) | ((a == 172) & b.between(16, 31))
        return inside & ~private

    first = F.try_element_at(F.filter(quads, public), F.lit(1))
    return F.coalesce(F.substring_index(first, ".", 3), F.lit(""))


def original_date(header: Column) -> Column:
    """A timestamp from the formats that corpora use, else the lowest timestamp; zones are dropped."""
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy")
    tried = [F.try_to_timestamp(header, F.lit(f)) for f in formats]
    return F.coalesce(*tried, F.try_to_timestamp(header), F.lit("0001-01-01 00:00:00").cast("timestamp"))


def header_value(raw: Column, name: str, most: int = 12_000) -> Column:
    """The value of a header in the first characters of a raw message."""
    return F.trim(F.regexp_extract(F.substring(raw, 1, most), rf"(?im)^{name}\s*:\s*(.+?)\s*$", 1))


def subject_of_raw(raw: Column) -> Column:
    """The first subject in the first 80 lines, at most 160 characters."""
    lines = F.slice(F.split(raw, "\n"), 1, 80)
    first = F.try_element_at(F.filter(lines, lambda x: F.lower(F.ltrim(x)).startswith("subject:")), F.lit(1))
    return F.coalesce(F.substring(F.regexp_replace(first, r"(?i)^\s*subject:\s*|\s+$", ""), 1, 160), F.lit(""))


def mask_envelope(c: Column, sender: Column, receiver: Column) -> Column:
    """A generated sender or receiver in a text to placeholders."""
    c = F.when(F.length(sender) > 0, F.replace(c, sender, F.lit("__sender__"))).otherwise(c)
    return F.when(F.length(receiver) > 0, F.replace(c, receiver, F.lit("__receiver__"))).otherwise(c)


def cue_flags(c: Column) -> list[Column]:
    return [F.lower(c).rlike(p).cast("int").alias(f"cue_{k}") for k, p in CUES.items()]


def two_decimals(c: Column) -> Column:
    """A share as a percentage with two decimals."""
    return F.format_string("%.2f%%", c * 100)
