"""Text functions, all built-in expressions: cleaning, mentions, lexicon sentiment, hashes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbols and names that count as mentions, and what the names stand for.
SYMBOLS = (
    "BTC", "ETH", "BNB", "SOL", "XRP", "ADA", "DOGE", "AVAX", "DOT", "MATIC", "LINK", "UNI", "ATOM", "LTC", "ETC", "XLM", "NEAR", "APT", "FIL", "ARB",
    "OP", "INJ", "SUI", "SEI", "TIA", "PEPE", "SHIB", "BONK",
)
NAMES = {"BITCOIN": "BTC", "ETHEREUM": "ETH", "BINANCE": "BNB", "SOLANA": "SOL", "RIPPLE": "XRP", "CARDANO": "ADA", "DOGECOIN": "DOGE"}


@dataclass(frozen=True)
class Lexicon:
    positive: tuple[str, ...]
    negative: tuple[str, ...]


# Word lists of the three rule-based scorers.
ARTICLE_WORDS = Lexicon(("bullish", "surge", "rally", "gain", "rise", "pump", "moon", "break", "ath"), ("bearish", "crash", "dump", "fall", "drop", "plunge", "sell", "fear", "hack"))
FEED_WORDS = Lexicon(
    ("surge", "rally", "bull", "gain", "rise", "soar", "high", "profit", "grow", "up", "breakout", "moon"),
    ("crash", "dump", "bear", "drop", "fall", "plunge", "low", "loss", "fear", "down", "sell", "decline"),
)
TITLE_WORDS = Lexicon(("surge", "rally", "bull", "gain", "rise", "soar"), ("crash", "dump", "bear", "drop", "fall", "plunge"))


def cleaned(text: Column) -> Column:
    """Tags go, then white space collapses and is trimmed (in this order: a tag leaves no blank behind)."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), r"\s+", " "))


def collapsed_then_stripped(text: Column) -> Column:
    """White space collapses and is trimmed, then tags go: blanks around tags stay."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), "<[^>]+>", "")


def word_count(text: Column) -> Column:
    """Parts between white space; an empty text counts as one part."""
    return F.size(F.split(text, r"\s+"))


def mentions(text: Column, symbols: tuple[str, ...] = SYMBOLS, names: dict[str, str] = NAMES) -> Column:
    """Sorted distinct symbols named in a text, by symbol or by name, in any case."""
    pattern = r"\b(" + "|".join([*symbols, *names]) + r")\b"
    found = F.regexp_extract_all(F.upper(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(1))
    if names:
        known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        found = F.transform(found, lambda x: F.coalesce(F.try_element_at(known, x), x))
    return F.array_sort(F.array_distinct(found))


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur in a text as substrings."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(0)
    for w in words:
        out = out + low.contains(w).cast("int")
    return out


def lexicon_sentiment(text: Column, lexicon: Lexicon = ARTICLE_WORDS) -> Column:
    """Struct (label, score, confidence): score (p - n) / (p + n), label beyond 0.2, confidence grows with
    the hits up to 0.9; without hits neutral, 0 and 0.5."""
    p, n = hits(text, lexicon.positive), hits(text, lexicon.negative)
    total = p + n
    score = F.when(total > 0, (p - n) / total).otherwise(F.lit(0.0))
    return F.struct(
        F.when(score > 0.2, "positive").when(score < -0.2, "negative").otherwise("neutral").alias("label"),
        score.alias("score"),
        F.when(total > 0, F.least(F.lit(0.5) + total * F.lit(0.1), F.lit(0.9))).otherwise(F.lit(0.5)).alias("confidence"),
    )


def majority_sentiment(text: Column, lexicon: Lexicon = FEED_WORDS) -> Column:
    p, n = hits(text, lexicon.positive), hits(text, lexicon.negative)
    return F.when(p > n, "positive").when(n > p, "negative").otherwise("neutral")


def content_hash(title: Column, content: Column, given: Column | None = None) -> Column:
    """SHA-256 of title, colon and the first 1000 characters; a hash that is given wins."""
    own = F.sha2(F.concat(F.coalesce(title, F.lit("")), F.lit(":"), F.substring(F.coalesce(content, F.lit("")), 1, 1000)), 256)
    return own if given is None else F.when(F.coalesce(given, F.lit("")) != "", given).otherwise(own)
