"""Text features, extraction and normalisation as column expressions."""

from __future__ import annotations

import string
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What counts as a word, a zero-width character and an emoji.
WORDS = r"[A-Za-z\x{0400}-\x{04FF}0-9]+"
# Hosts that shorten addresses.
SHORTENERS = ("bit.ly", "t.co", "tinyurl.com", "goo.gl", "cutt.ly", "is.gd", "s.id", "clck.ru", "vk.cc", "ow.ly", "shorturl.at", "rebrand.ly")
ZERO_WIDTH = r"[\x{200B}\x{200C}\x{200D}\x{200E}\x{200F}\x{2060}\x{FEFF}]"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{26FF}\x{2700}-\x{27BF}]"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
#: A web address: with a scheme or www., or a bare host with a top-level label of letters and a path. A host that
#: can start within a word can start where that word does, so no other place is tried.
URL = r"(?i)(?:https?://|www\.)[^\x20\x09-\x0D<>\"']+|(?<![a-z0-9])(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,24}(?:/[^\x20\x09-\x0D<>\"']*)?"
#: Invite links: plain; with the dots spelt out or bracketed; with backslashes.
_CODE = r"([A-Za-z0-9_-]{2,64})"
INVITES = (
    rf"(?i)discord(?:\.gg|(?:app)?\.com/invite)/{_CODE}",
    rf"(?i)discord[\x20]*(?:\[\.\]|\(\.\)|[\x20]dot[\x20]|[\x20]+\.|\.[\x20]+)[\x20]*gg[\x20]*/[\x20]*{_CODE}",
    rf"(?i)discord\.gg\\+{_CODE}",
)
USER_MENTION, ROLE_MENTION, CHANNEL_MENTION = r"<@!?[0-9]+>", r"<@&[0-9]+>", r"<#[0-9]+>"


def let(value: Column, use) -> Column:
    """use(value) with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _kept(text: Column, drop: str) -> Column:
    """Characters that are left without those of a class."""
    return F.length(F.regexp_replace(text, drop, ""))


def _quotient(a: Column, b: Column, places: int) -> Column:
    """a / b of whole numbers, rounded half up without the noise of floating point; 0 for b = 0."""
    unit = 10**places
    return F.when(b > 0, F.floor((a * (2 * unit) + b) / (b * 2)) / unit).otherwise(F.lit(0.0))


def _ratio(a: Column, b: Column) -> Column:
    return _quotient(a, b, 3)


def words(text: Column) -> Column:
    return _all(text, WORDS)


#: What every text with an address has; cheap to look for.
_MAY_HAVE_URL = r"(?i)://|www\.|[a-z0-9]\.[a-z]"


def urls(text: Column) -> Column:
    """Addresses in the order of first occurrence, without punctuation at their ends."""
    found = F.array_distinct(F.transform(_all(text, URL), lambda u: F.regexp_replace(u, r"[.,;:!?)\]}]+$", "")))
    return F.when(text.rlike(_MAY_HAVE_URL), found).when(text.isNotNull(), F.array().cast("array<string>"))


def domain(url: Column) -> Column:
    """The authority of an address, in lower case, without one leading www."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(url), r"^[a-z][a-z0-9+.-]*://", ""), r"[/?#].*$", "")
    return F.regexp_replace(bare, r"^www\.", "")


def domains(url_array: Column) -> Column:
    return F.array_distinct(F.transform(url_array, domain))


def parent_suffixes(host: Column) -> Column:
    """a.b.c to a.b.c, b.c and c, so that a suffix match becomes a join by equality."""
    parts = F.split(F.regexp_replace(host, r"^www\.", ""), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def matches_suffix(host: Column, patterns) -> Column:
    """Whether a host is one of the patterns or below one."""
    clean = F.regexp_replace(host, r"^www\.", "")
    out = F.lit(False)
    for p in patterns:
        out = out | (clean == p) | clean.endswith("." + p)
    return out


def invites(text: Column) -> Column:
    """Codes in lower case, in the order of grammars, each once."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in INVITES]
    codes = F.array_distinct(F.transform(F.concat(*found), F.lower))
    return F.when(text.rlike("(?i)discord"), codes).when(text.isNotNull(), F.array().cast("array<string>"))


def has_obfuscated_invite(text: Column) -> Column:
    return text.rlike(INVITES[1]) | text.rlike(INVITES[2])


def mentions(text: Column) -> dict[str, Column]:
    each = (("user", USER_MENTION), ("role", ROLE_MENTION), ("channel", CHANNEL_MENTION))
    return {k: F.regexp_count(text, F.lit(p)).cast("long") for k, p in each}


def directly_addressed(text: Column) -> Column:
    """Mentions of users as the direct address that they stand for."""
    return F.regexp_replace(text, USER_MENTION, " ты ")


def metric_text(text: Column) -> Column:
    """The text with each address replaced by one space."""
    return F.when(text.rlike(_MAY_HAVE_URL), F.regexp_replace(text, URL, " ")).otherwise(text)


def language(has_cyrillic: Column, has_latin: Column) -> Column:
    return (
        F.when(has_cyrillic & has_latin, "mixed").when(has_cyrillic, "ru").when(has_latin, "en").otherwise("unknown")
    )


def longest_run(text: Column) -> Column:
    """The longest run of one letter, whatever its case."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L})\1+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.when(text.rlike(r"\p{L}"), 1).otherwise(0))


def most_frequent_word(found: Column) -> Column:
    """Of an array of words, occurrences of the most frequent one of two or more characters: runs in order."""
    long = F.sort_array(F.transform(F.filter(found, lambda w: F.length(w) >= 2), F.lower))
    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("most"))

    def step(acc: Column, w: Column) -> Column:
        n = F.when(acc["w"] == w, acc["n"] + 1).otherwise(1)
        return F.struct(w.alias("w"), n.alias("n"), F.greatest(acc["most"], n).alias("most"))

    return F.aggregate(long, start, step, lambda acc: acc["most"])


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds all text features. The work is laid out in three projections, so that each list of words,
    addresses and cleaned text is computed once a row."""
    raw = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"_raw": raw, "_words": words(raw), "_metric": metric_text(raw), "urls": urls(raw), "invites": invites(raw)})
    m = F.col("_metric")
    size = F.length("_metric")
    sizes = F.transform(F.col("_words"), F.length)
    df = df.withColumns({
        "_letters": _kept(m, r"[^\p{L}]+"),
        "_upper": _kept(m, r"[^\p{Lu}]+"),
        "_punct": size - F.length(F.translate(m, string.punctuation, "")),
        "_emoji": F.regexp_count(m, F.lit(EMOJI)),
        "_run": longest_run(m),
        "_most": most_frequent_word(F.col("_words")),
        "_size": size,
        "_sizes": sizes,
        "domains": domains(F.col("urls")),
    })
    raw, n_words = F.col("_raw"), F.size("_words")
    count = lambda p: F.regexp_count(m, F.lit(p))
    cyr, lat = m.rlike(r"[\x{0400}-\x{04FF}]"), m.rlike(r"[A-Za-z]")
    lines = F.length(raw) - F.length(F.replace(raw, F.lit("\n"), F.lit("")))
    out = {
        "text_length": F.length(raw).cast("long"),
        "word_count": n_words.cast("long"),
        "newline_count": lines.cast("long"),
        "line_count": F.when(F.length(raw) > 0, lines + 1).otherwise(0).cast("long"),
        "spaces_count": (F.length(raw) - F.length(F.replace(raw, F.lit(" "), F.lit("")))).cast("long"),
        "unique_chars": F.size(F.array_distinct(F.filter(F.split(raw, ""), lambda c: c != ""))).cast("long"),
        "average_word_length": _quotient(F.aggregate("_sizes", F.lit(0), lambda a, x: a + x), n_words, 2),
        "longest_word_length": F.coalesce(F.array_max("_sizes"), F.lit(0)).cast("long"),
        "uppercase_ratio": _ratio(F.col("_upper"), F.col("_letters")),
        "digit_ratio": _ratio(count(r"\p{Nd}"), F.col("_size")),
        "punctuation_count": F.col("_punct").cast("long"),
        "punctuation_ratio": _ratio(F.col("_punct"), F.col("_size")),
        "emoji_count": F.col("_emoji").cast("long"),
        "emoji_ratio": _ratio(F.col("_emoji"), F.col("_size")),
        "repeated_char_score": F.least(F.greatest((F.col("_run") - 1) / 10, F.lit(0.0)), F.lit(1.0)),
        "has_repeated_chars": F.col("_run") >= 3,
        "max_word_repetition_count": F.col("_most").cast("long"),
        "max_word_repetition_ratio": _ratio(F.col("_most"), n_words),
        "has_cyrillic": cyr,
        "has_latin": lat,
        "has_mixed_scripts": cyr & lat,
        "has_zero_width": raw.rlike(ZERO_WIDTH),
        "has_suspicious_unicode": raw.rlike(r"[\p{Cf}\p{Cc}&&[^\n\r\t]]"),
        "language": language(cyr, lat),
        "url_count": F.size("urls").cast("long"),
        "invite_count": F.size("invites").cast("long"),
        "has_url": F.size("urls") > 0,
        "has_invite": F.size("invites") > 0,
        "has_shortener": F.exists("domains", lambda d: matches_suffix(d, SHORTENERS)),
    }
    return df.withColumns(out).drop("_raw", "_words", "_metric", "_letters", "_upper", "_run", "_most", "_size", "_sizes", "_punct", "_emoji")


def age_days(at: Column, since: Column) -> Column:
    """Whole days between, at least 0; null if either is."""
    days = F.floor((F.unix_micros(at.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / 86_400_000_000)
    return F.when(days.isNotNull(), F.greatest(days, F.lit(0))).cast("long")


@F.pandas_udf(StringType())
def _fold(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


def folded(text: Column) -> Column:
    """Compatibility-composed, case-folded text; ASCII text, for which that is its lower case, stays in the JVM."""
    return F.when(text.rlike(r"^\p{ASCII}*$"), F.lower(text)).otherwise(_fold(F.when(~text.rlike(r"^\p{ASCII}*$"), text)))


@F.pandas_udf(StringType())
def _casefold(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(str.casefold, na_action="ignore")


def casefolded(text: Column) -> Column:
    """Case-folded text; ASCII text, for which that is its lower case, stays in the JVM."""
    plain = text.rlike(r"^\p{ASCII}*$")
    return F.when(plain, F.lower(text)).otherwise(_casefold(F.when(~plain, text)))


def squeezed(text: Column) -> Column:
    # single blanks, which most runs of white space are, stay as they are
    return F.trim(F.regexp_replace(text, r"(?U)[^\S\x20]\s*|\x20\s+", " "))


def normalized(text: Column, collapse_repeats: bool = True) -> Column:
    """Folded, without zero-width characters, single spaces; three or more of a character become two."""
    out = squeezed(F.regexp_replace(folded(text), ZERO_WIDTH, ""))
    return F.regexp_replace(out, r"(?s)(.)\1{2,}", "$1$1") if collapse_repeats else out


def curation_key(text: Column) -> Column:
    """The key by which curated texts are equal."""
    return squeezed(folded(text))


def simple_key(text: Column) -> Column:
    """A key without folding, for which SQL engines agree: lower case and single spaces."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", " "))


def ocr_normalized(text: Column) -> Column:
    """Compatibility-composed recognised text, without control and bidirectional marks; lines stay."""
    out = _compose(text)
    out = F.regexp_replace(out, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"[\p{Cf}\p{Cc}&&[^\n\t]]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r" ?\n ?", "\n"))


@F.pandas_udf(StringType())
def _compose(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def keyword_pattern(keyword: str) -> str:
    """A pattern for a keyword with * for word characters and hyphens; one without a space must stand alone."""
    import re

    body = r"[\w-]*".join(re.escape(x) for x in keyword.split("*"))
    return rf"(?U)(?<!\w){body}(?!\w)" if " " not in keyword else rf"(?U){body}"


def any_keyword(text: Column, keywords) -> Column:
    out = F.lit(False)
    for k in keywords:
        out = out | text.rlike(keyword_pattern(k))
    return out
