"""Text expressions: normalising, redaction, classes, token sets."""

from __future__ import annotations

import html
import json
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadline.functions.columns import c, let

#: Inside brackets: Unicode's blanks and the four separators, as Python's \\s; and that no letter, digit or underscore follows.
BLANK = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD_END = r"(?:[^\p{L}\p{N}_]|$)"

#: What a conventional title begins with, and the types that have other names.
PREFIX = (
    r"(?i)^\s*(?:\[[^\]]+\]\s*)?"
    r"(feat(?:ure)?|fix|bugfix|docs?|documentation|test|tests|refactor|"
    r"chore|build|ci|perf|style|revert)"
    r"(?:\([^)]+\))?!?\s*:\s*"
)
ALIASES = {"feature": "feat", "bugfix": "fix", "doc": "docs", "documentation": "docs", "tests": "test"}
#: Tags that a title leads with, names of products, and what a token is.
LEADING_TAG = r"(?i)^\s*(?:\[[^\]]{1,30}\]\s*)?(?:(?:feat|fix|chore|docs|test|refactor|style|build|ci|perf)(?:\([^)]*\))?[!:]\s*)+"
PRODUCT = r"(?i)\b(?:openai[ _-]?codex|codex|claude[ _-]?code|claude|copilot|cursor|google[ _-]?jules|jules|devin)\b"
TOKEN = r"[a-z0-9][a-z0-9_.+/-]*"


def normalise(text: Column | str) -> Column:
    """Unescaped, lower case, without leading tags; products, addresses and hashes by marks; single spaces. Null is empty."""
    x = F.regexp_replace(F.lower(unescape(F.coalesce(c(text), F.lit("")))), LEADING_TAG, "")
    for pattern, by in ((PRODUCT, " agent "), (rf"https?://[^{BLANK}]+", " url "), (r"\b[0-9a-f]{8,40}\b", " sha "), (rf"[{BLANK}]+", " ")):
        x = F.regexp_replace(x, pattern, by)
    return F.trim(x)


def words(text: Column | str) -> Column:
    """Tokens of a normalised text, repeats included."""
    return F.regexp_extract_all(normalise(text), F.lit(TOKEN), F.lit(0))


@lru_cache(maxsize=1)
def _entities() -> dict[str, str]:
    """Names of HTML 5 with their characters; those that may lack a semicolon are there without it too."""
    return dict(html.entities.html5)


def _char(number: Column) -> Column:
    """The character of a code point up to 10ffff."""
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def _numbered(digits: Column) -> Column:
    """What a numbered reference stands for: Windows letters for 80 to 9f, a mark for what is no character, nothing for controls."""
    base16 = F.lower(F.substring(digits, 2, 1)) == "x"
    plain = F.regexp_replace(F.rtrim(F.regexp_replace(digits, "^#[xX]?", ""), F.lit(";")), "^0+", "")
    n = F.when(F.length(plain) > 8, F.lit(0x110000)).otherwise(F.conv(F.when(plain == "", "0").otherwise(plain), 10, 10).cast("bigint"))
    n = F.when(base16, F.when(F.length(plain) > 8, F.lit(0x110000)).otherwise(F.conv(F.when(plain == "", "0").otherwise(plain), 16, 10).cast("bigint"))).otherwise(n)
    windows = {i: bytes([i]).decode("cp1252") for i in range(0x80, 0xA0) if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
    letters = F.create_map(*(F.lit(x) for i, ch in windows.items() for x in (i, ch)))

    def of(n: Column) -> Column:
        control = n.between(1, 8) | n.between(0xE, 0x1F) | n.between(0x7F, 0x9F) | n.between(0xFDD0, 0xFDEF) | (n == 0xB) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
        return (
            F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd").when(n == 0xD, "\r").when(n.between(0x80, 0x9F), F.coalesce(F.try_element_at(letters, n.cast("int")), _char(n)))
            .when(control, "").otherwise(_char(n))
        )

    return let(n, of)


def unescape(text: Column | str) -> Column:
    """HTML's references, named (with HTML 5's rule for names without a semicolon) and numbered, as Python's html.unescape reads them; once."""
    named = _entities()
    table = F.from_json(F.lit(json.dumps(named)), "map<string,string>")
    short = sorted((k for k in named if not k.endswith(";")), key=lambda k: (-len(k), k))

    def part(p: Column, k: Column) -> Column:
        number = F.regexp_extract(p, "^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?)", 0)
        whole = F.regexp_extract(p, r"^[^\t\n\f <&#;]{1,32};?", 0)
        legacy = F.regexp_extract(p, f"^(?:{'|'.join(short)})", 0)
        exact = F.try_element_at(table, whole)
        rest = (
            F.when(number != "", F.concat(_numbered(number), F.substr(p, F.length(number) + 1)))
            .when(exact.isNotNull(), F.concat(exact, F.substr(p, F.length(whole) + 1)))
            .when(legacy != "", F.concat(F.try_element_at(table, legacy), F.substr(p, F.length(legacy) + 1)))
            .otherwise(F.concat(F.lit("&"), p))
        )
        return F.when(k == 0, p).otherwise(rest)

    x = c(text)
    return F.when(F.contains(x, F.lit("&")), F.array_join(F.transform(F.split(x, "&"), part), "")).otherwise(x)


#: The references that occur in titles of pages, in the order in which they are replaced; the mark itself comes last.
CLOSED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescape_closed(text: Column | str) -> Column:
    """Six common references that end in a semicolon; one that is cut off, as at the end of a cut title, stays as it is."""
    x = c(text)
    for reference, by in CLOSED:
        x = F.replace(x, F.lit(reference), F.lit(by))
    return x


def redact(text: Column | str, max_chars: int | None = None) -> Column:
    """Secrets, addresses and mails by marks, and blanks collapsed, over the whole text; cut to max_chars only for a packet."""
    x = c(text)
    for pattern, by in ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"), (r"https?://[^ \t\n]+", "[URL]"), (r"\b[0-9a-f]{32,}\b", "[TOKEN]"), (r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b", "[IP]"), (r"[ \t]+", " ")):
        x = F.regexp_replace(x, pattern, by)
    return x if max_chars is None else F.substring(x, 1, max_chars)


def word_count(text: Column | str) -> Column:
    return F.size(F.regexp_extract_all(c(text), F.lit(r"[A-Za-z0-9']+"), F.lit(0))).cast("bigint")


def task_of_title(title: Column | str) -> Column:
    """The type that a conventional prefix names; others are null."""
    kind = F.lower(F.regexp_extract(c(title), PREFIX, 1))
    aliases = F.create_map(*(F.lit(x) for k, v in ALIASES.items() for x in (k, v)))
    return F.when(kind != "", F.coalesce(F.try_element_at(aliases, kind), kind))


def issue_refs(text: Column | str) -> Column:
    """Distinct issue numbers that a text names with # or by an issue's address."""
    x = F.coalesce(c(text), F.lit(""))
    found = F.concat(*(F.regexp_extract_all(x, F.lit(p), F.lit(1)) for p in (r"(?<![A-Za-z0-9_])#(\d+)", r"(?i)github\.com/[^/]+/[^/]+/issues/(\d+)")))
    return F.array_sort(F.array_distinct(found))


def tokens(text: Column | str) -> Column:
    """Distinct tokens of a normalised text."""
    return F.array_distinct(words(text))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two sets; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Shared over the smaller of two sets."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.least(F.size(a), F.size(b)).cast("double"))
