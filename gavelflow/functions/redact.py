"""Redaction of personal data and secrets, with what was found, and marks of prompt injection."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gavelflow.functions import text as T

# What is replaced, in the order of work, and what takes its place.
EMAIL = r"(?U)(?<![\w.+-])[\w.+-]++@[\w-]+(?:\.[\w-]+)+(?![\w.-])"
PHONE = r"(?U)(?<!\w)(?:\+?\d[\d\s().-]{7,}\d)(?!\w)"
IPV4 = r"(?U)(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w.])"
CARD = r"(?U)(?<!\d)(?:\d[ -]?){15,18}\d(?!\d)"
ACCESS_TOKEN = r"(?iU)(?<![\w.-])(?:mfa\.[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})(?![\w.-])"
SECRET = r"(?iU)\b(?:token|api[_-]?key|secret|password)\s*[:=]\s*[^\s,;]{6,}"
KINDS = (
    ("access_token", ACCESS_TOKEN, "<ACCESS_TOKEN>"),
    ("secret", SECRET, "<SECRET>"),
    ("ip", IPV4, "<IP>"),
    ("discord_role_mention", r"(?U)<@&\d{5,25}>", "<DISCORD_ROLE_MENTION>"),
    ("discord_channel_mention", r"(?U)<#\d{5,25}>", "<DISCORD_CHANNEL_MENTION>"),
    ("discord_user_mention", r"(?U)<@!?\d{5,25}>", "<DISCORD_USER_MENTION>"),
    ("email", EMAIL, "<EMAIL>"),
)
#: What a text that a kind matches has; cheap to look for.
_MAY_HAVE = {
    "access_token": r"(?i)mfa\.|eyJ", "secret": "[:=]", "ip": r"\p{Nd}\.\p{Nd}", "discord_role_mention": "<@&", "discord_channel_mention": "<#", "discord_user_mention": "<@",
    "email": "@", "card": r"\p{Nd}", "phone": r"\p{Nd}",
}
LATE_KINDS = (("card", CARD, "<CARD>"), ("phone", PHONE, "<PHONE>"))
INVITE_TOKEN, URL_TOKEN = "<DISCORD_INVITE>", "<URL>"
PLACEHOLDER = r"(?i)<(?:URL_DOMAIN:[a-z0-9.-]+|DISCORD_INVITE|DISCORD_USER_MENTION|DISCORD_ROLE_MENTION|DISCORD_CHANNEL_MENTION|EMAIL|PHONE|IP|CARD|ACCESS_TOKEN|SECRET|URL)>"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
# Addresses and invites in training texts.
TRAINING_URL = r"(?iU)<?\b(?:https?://|www\.)[^\s<>]+>?|(?<!@)\b[a-z0-9.-]+\.[a-z]{2,}(?:/[^\s<>]*)?"
TRAINING_INVITE = r"(?i)(?:https?://)?(?:discord\.gg|discord(?:app)?\.com/invite)/[a-z0-9_-]+"
# Instructions aimed at a model that reads the text.
INJECTIONS = (
    ("ignore_previous_instructions", r"(?iU)\bignore\s+(?:all\s+)?previous\s+instructions\b"),
    ("system_prompt_reference", r"(?iU)\b(?:system|developer)\s+prompt\b"),
    ("role_instruction", r"(?iU)\b(?:you\s+are|act\s+as)\s+(?:chatgpt|an?\s+ai|system)\b"),
    ("safe_label_instruction", r"(?iU)\b(?:mark|classify|label)\s+(?:this\s+)?(?:as\s+)?safe\b"),
)
_FOUND = "array<struct<kind:string,token:string,count:long,domain:string>>"


def injection_markers(text: Column) -> Column:
    """Names of the injection patterns that a text shows."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in INJECTIONS]))


def _rejoined(parts: Column, between: Column) -> Column:
    """The parts of a split text with something else between them."""
    return F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(between, i), F.lit("")))), "")


def _replaced(text: Column, kind: str, pattern: str, token: str) -> Column:
    return F.when(text.rlike(_MAY_HAVE[kind]), F.regexp_replace(text, pattern, token)).otherwise(text)


def _key(i: Column) -> Column:
    return F.concat(F.lit("__sanitized_token_"), i.cast("string"), F.lit("__"))


def protected(text: Column) -> Column:
    """The text with its placeholders, of whatever case, as words that no pattern matches."""

    def hide(v: Column) -> Column:
        found = F.regexp_extract_all(v, F.lit(PLACEHOLDER), F.lit(0))
        return F.when(v.rlike(PLACEHOLDER), _rejoined(F.split(v, PLACEHOLDER, -1), F.transform(found, lambda _, i: _key(i)))).otherwise(v)

    return T.let(text, hide)


def restored(out: Column, text: Column) -> Column:
    """out with the placeholders of the text, which it hides, in their canonical case."""
    found = F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))
    domain = lambda t: F.concat(F.lit("<URL_DOMAIN:"), F.lower(F.substring(t, 13, 1 << 20)))
    canonical = lambda t: F.when(F.lower(t).startswith("<url_domain:"), domain(t)).otherwise(F.upper(t))
    each = F.transform(found, lambda t, i: F.struct(_key(i).alias("k"), canonical(t).alias("t")))
    return F.aggregate(each, out, lambda acc, e: F.replace(acc, e["k"], e["t"]))


def _host(url: Column) -> Column:
    """The authority of an address in lower case without www., or '' if it isn't a plain host."""
    bare = F.regexp_replace(url, "^[<>]+|[<>]+$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)", 1)), r"^www\.", "")
    return F.when(host.rlike(r"^[a-z0-9.-]{1,253}$"), host).otherwise("")


def url_token(url: Column) -> Column:
    """What stands for an address: an invite, its domain, or just an address."""
    is_invite = (F.size(T.invites(url)) > 0) | T.has_obfuscated_invite(url)
    return F.when(is_invite, INVITE_TOKEN).otherwise(_domain_token(url))


def _domain_token(url: Column) -> Column:
    return T.let(_host(url), lambda h: F.when(h != "", F.concat(F.lit("<URL_DOMAIN:"), h, F.lit(">"))).otherwise(URL_TOKEN))


def _without_urls(text: Column, urls: Column) -> Column:
    """struct<t, found>: the text with its addresses replaced, the longest first, in their own case or else
    folded."""
    order = F.array_sort(F.transform(urls, lambda u, i: F.struct((-F.length(u)).alias("l"), i.alias("i"), u.alias("u"))))
    start = F.struct(text.alias("t"), F.array().cast(_FOUND).alias("found"))

    def step(acc: Column, e: Column) -> Column:
        u = e["u"]
        at = F.when(acc["t"].contains(u), u).when(acc["t"].contains(F.lower(u)), F.lower(u))
        token = url_token(u)
        one = F.struct(F.lit("url").alias("kind"), token.alias("token"), F.lit(None).cast("long").alias("count"), _host(u).alias("domain"))
        return F.when(at.isNull(), acc).otherwise(F.struct(F.replace(acc["t"], at, token).alias("t"), F.concat(acc["found"], F.array(one)).alias("found")))

    return F.aggregate(order, start, step)


def redact(df: DataFrame, text: str = "text", out: str = "redacted", urls: str | None = None) -> DataFrame:
    """Adds out, the text redacted for storage; redactions, array<struct<kind, token, count, domain>> of what was
    replaced, in order; injection_markers; and text_hash, the SHA-256 of out. urls: a column with the addresses of
    the text as it came in; by default those of text.

    Control characters become blanks; placeholders that are there stay; then come the kinds, addresses, cards and
    phone numbers; white space is squeezed. One projection a kind, which counts only where it has replaced."""
    source = F.coalesce(F.col(text), F.lit(""))
    x = df.withColumn("_clean", F.regexp_replace(source, CONTROL, " "))
    x = x.withColumn("_r", protected(F.col("_clean")))
    counts: dict[str, Column] = {}

    def replace(x: DataFrame, kind: str, pattern: str, token: str) -> DataFrame:
        x = x.withColumn("_next", _replaced(F.col("_r"), kind, pattern, token))
        n = F.when(F.col("_next") != F.col("_r"), F.regexp_count("_r", F.lit(pattern)).cast("long"))
        one = F.struct(F.lit(kind).alias("kind"), F.lit(token).alias("token"), F.col(f"_n_{kind}").alias("count"), F.lit(None).cast("string").alias("domain"))
        counts[kind] = F.when(F.col(f"_n_{kind}") > 0, one)
        return x.withColumn(f"_n_{kind}", n).drop("_r").withColumnRenamed("_next", "_r")

    for kind, pattern, token in KINDS:
        x = replace(x, kind, pattern, token)
    early = list(counts.values())
    x = x.withColumn("_u", _without_urls(F.col("_r"), F.col(urls) if urls else T.urls(source)))
    x = x.withColumn("_r", F.col("_u.t"))
    for kind, pattern, token in LATE_KINDS:
        x = replace(x, kind, pattern, token)
    late = [counts[k] for k, _, _ in LATE_KINDS]
    found = F.concat(F.array_compact(F.array(*early)), F.col("_u.found"), F.array_compact(F.array(*late)))
    x = x.withColumns({out: T.squeezed(restored(F.col("_r"), F.col("_clean"))), "redactions": found, "injection_markers": injection_markers(source)})
    x = x.withColumn("text_hash", F.sha2(out, 256))
    return x.drop("_clean", "_r", "_u", *[f"_n_{k}" for k in counts])


def training_text(df: DataFrame, text: str = "text", out: str = "training_text") -> DataFrame:
    """Adds out: case-folded and redacted text for training; doing it twice changes nothing, as placeholders stay.
    Folding, which needs Python for some texts, is a projection of its own, below the lambdas."""
    source = F.coalesce(F.col(text), F.lit(""))
    x = T.casefolded(F.col("_p"))
    for _, pattern, token in KINDS:
        x = F.regexp_replace(x, pattern, token)
    df = df.withColumn("_p", protected(source)).withColumn("_r", F.regexp_replace(x, TRAINING_INVITE, INVITE_TOKEN))
    v = F.col("_r")
    found = F.transform(F.regexp_extract_all(v, F.lit(TRAINING_URL), F.lit(0)), _domain_token)
    y = F.when(v.rlike(TRAINING_URL), _rejoined(F.split(v, TRAINING_URL, -1), found)).otherwise(v)
    for _, pattern, token in LATE_KINDS:
        y = F.regexp_replace(y, pattern, token)
    return df.withColumn(out, T.squeezed(restored(y, source))).drop("_p", "_r")


def masked_url(url: Column) -> Column:
    """A connection string without its password."""
    return F.regexp_replace(url, r"^([a-z][a-z0-9+.-]*://[^:/@]*):[^@]*@", "$1:***@")


def metadata_allowed(metadata: Column, keys=("event_type", "feature_version")) -> Column:
    """JSON of the entries of a map whose keys may be stored."""
    return F.to_json(F.map_filter(metadata, lambda k, _: k.isin(*keys)))


# -- recognised text ------------------------------------------------------------------------------

# What is replaced in recognised text, and the flag of each.
OCR_EMAIL = r"(?U)(?<![\w.+-])[\w.+-]{1,64}@[A-Za-z0-9.-]{1,253}\.[A-Za-z]{2,63}"
OCR_PHONE = r"(?U)(?<!\d)(?:\+?\d[\d ()-]{7,}\d)(?!\d)"
OCR_SECRET = r"(?iU)\b(?:api[_-]?key|token|secret|password)\s*[:=]\s*[A-Za-z0-9_./+\-=]{8,}"
OCR_WALLET = r"(?U)\b(?:0x[a-fA-F0-9]{40}|bc1[a-zA-HJ-NP-Z0-9]{25,90}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})\b"
OCR_URL = r"(?iU)https?://[^\s<>]{1,2048}"
OCR_INJECTION = r"(?iU)(?:ignore|disregard|forget)\s+(?:all\s+)?(?:previous|prior|system)\s+(?:instructions?|prompts?)"
_CARD = re.compile(r"(?<!\d)(?:\d[ -]?){13,19}(?!\d)")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


@F.pandas_udf(StringType())
def redact_cards(s: pd.Series) -> pd.Series:
    """Card numbers: 13 to 19 digits, not all equal, with a right check digit. The check needs each match by
    itself, which the built-in replacement has no place for."""

    def one(m: re.Match) -> str:
        digits = "".join(c for c in m[0] if c.isdigit())
        return "[PAYMENT_CARD]" if 13 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn(digits) else m[0]

    return s.map(lambda x: _CARD.sub(one, x), na_action="ignore")


def _ocr_host(url: Column) -> Column:
    """[URL:host], without user, password and port."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    clean = F.regexp_replace(F.regexp_replace(host, r"[\[\]]", ""), r"\.+$", "")
    return F.concat(F.lit("[URL:"), F.when(host == "", "unknown").otherwise(clean), F.lit("]"))


def ocr_redact(df: DataFrame, text: str, most: int = 8000) -> DataFrame:
    """Adds redacted, ocr_hash (of the normalised text before, up to most characters), ocr_language and flags to
    recognised text; nothing but empty values for an empty one."""
    x = df.withColumn("_n", F.substring(F.coalesce(T.ocr_normalized(F.col(text)), F.lit("")), 1, most))
    x = x.withColumn("_email", F.regexp_replace("_n", OCR_EMAIL, "[EMAIL]"))
    has_digits = F.col("_email").rlike(r"(?U)(?:\d[ -]?){13}")
    x = x.withColumn("_card", F.coalesce(redact_cards(F.when(has_digits, F.col("_email"))), F.col("_email")))
    x = x.withColumn("_phone", F.regexp_replace("_card", OCR_PHONE, "[PHONE]"))
    x = x.withColumn("_secret", F.regexp_replace("_phone", OCR_SECRET, "[ACCESS_SECRET]"))
    x = x.withColumn("_wallet", F.regexp_replace("_secret", OCR_WALLET, "[PAYMENT_WALLET]"))
    x = x.withColumn("_urls", F.regexp_extract_all("_wallet", F.lit(OCR_URL), F.lit(0)))
    steps = [("email", "_n", "_email"), ("payment_card", "_email", "_card"), ("phone", "_card", "_phone"), ("access_secret", "_phone", "_secret"), ("payment_wallet", "_secret", "_wallet")]
    sensitive = F.exists("_urls", lambda u: u.rlike(r"[?#].|://[^/?#]+@"))
    flags = F.array_compact(F.array(
        *[F.when(F.col(a) != F.col(b), F.lit(k)) for k, a, b in steps], F.when(sensitive, F.lit("sensitive_url")), F.when(F.col("_n").rlike(OCR_INJECTION), F.lit("prompt_injection"))
    ))
    out = _rejoined(F.split("_wallet", OCR_URL, -1), F.transform("_urls", _ocr_host))
    x = x.withColumns({"redacted": out, "flags": flags, "ocr_hash": F.when(F.length("_n") > 0, F.sha2("_n", 256)), "ocr_language": ocr_language(F.col("_n"))})
    return x.drop("_n", "_urls", *[b for _, _, b in steps])


def ocr_language(text: Column) -> Column:
    """By whether there are letters of either script; null for neither."""
    cyr, lat = text.rlike("(?iu)[а-яё]"), text.rlike("(?i)[a-z]")
    return F.when(cyr & lat, "ru-en").when(cyr, "ru").when(lat, "en")
