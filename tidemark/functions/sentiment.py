"""Lexicon sentiment over whole tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Words of good and of bad news.
POSITIVE_WORDS = [
    "surge", "rally", "bull", "breakout", "win", "approval", "green", "recover", "record",
    "ath", "up", "optimism", "strong", "growth", "inflows", "partnership", "upgrade", "positive",
    "gain", "profit", "rise", "launch", "adoption", "listing", "milestone", "soar",
]
NEGATIVE_WORDS = [
    "crash", "dump", "bear", "hack", "lawsuit", "ban", "liquidation", "down", "fear", "panic",
    "exploit", "loss", "outflow", "scam", "negative", "weak", "collapse", "warning", "sell",
    "drop", "decline", "fraud", "security", "breach", "delist", "suspension", "investigation",
]


def tokens(text: Column) -> Column:
    """Lower-case runs of letters a to z, digits and apostrophes."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9']+)"), F.lit(1))


def matches(text: Column, words: list[str]) -> Column:
    """The tokens of a text that are among ``words``, in one pass and without a list of all tokens."""
    guard = "[a-z0-9']"
    first = "".join(sorted({w[0] for w in words}))
    any_ = "|".join(sorted(words, key=len, reverse=True))
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"(?=[{first}])(?<!{guard})(?:{any_})(?!{guard})"), F.lit(0))


def lexicon_score(text: Column, positive: list[str] = POSITIVE_WORDS, negative: list[str] = NEGATIVE_WORDS) -> Column:
    """(p - n) / (p + n) over tokens in the two lists of plain words; 0 where there are none."""

    def of(found: Column) -> Column:
        n = F.size(found)
        p = F.size(F.filter(found, lambda t: t.isin(*positive)))
        return F.when(n > 0, (2 * p - n) / n).otherwise(0.0)

    return F.transform(F.array(matches(text, [*positive, *negative])), of)[0]  # bound once, used twice


def keyword_match(text: Column, keyword: str) -> Column:
    """Whether a text has a keyword: a single one among its tokens, a phrase anywhere in its tokens joined by spaces."""
    found = tokens(text)
    words = keyword.lower().split()
    return F.array_contains(found, words[0]) if len(words) == 1 else F.contains(F.array_join(found, " "), F.lit(" ".join(words)))


def vote(score: Column, threshold: float = 0.35) -> Column:
    """1, -1 or 0: whether a score reaches the threshold on either side."""
    return F.when(score >= threshold, 1).when(score <= -threshold, -1).otherwise(0)
