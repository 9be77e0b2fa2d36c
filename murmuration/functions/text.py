"""Text rules as column expressions: mentions, cleaning, tokens, hashtags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these patterns, words and formats.
MENTION_PATTERN = r"@(\w{3,})"
SHORT_MENTION_PATTERN = r"@(\w+)"
URL_PATTERN = r"(http|ftp|https)://[A-Za-z0-9-_]+.[A-Za-z0-9-_:%&?/.=]+"
SMILEY_PATTERN = r"((?::|;|=)(?:-)?(?:\)|D|P|3|O))"
PUNCTUATION_PATTERN = r"[!?.,:;<>)(]"
LETTERS_PATTERN = r"^\p{L}+$"
ALPHABETIC_PATTERN = r"^\p{IsAlphabetic}+$"
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"
MIN_TOKEN_CHARS = 4
STOP_WORDS = (
    "that have with this from they would there their what about which when make like time just know take into year "
    "your good some could them other than then look only come over think also back after work first well even want "
    "because these give most http https fpt"
).split()


def mention_pattern(min_chars: int = 3, require_boundary: bool = False) -> str:
    """``@name`` with at least ``min_chars`` word characters; optionally not inside a word such as an e-mail address."""
    size = "+" if min_chars == 1 else f"{{{min_chars},}}"
    return (r"(?<!\w)" if require_boundary else "") + rf"@(\w{size})"


def first_mention(text: Column, pattern: str = MENTION_PATTERN) -> Column:
    """Name of the first mention, or an empty string."""
    return F.regexp_extract(text, pattern, 1)


def all_mentions(text: Column, pattern: str = MENTION_PATTERN) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def clean_text(text: Column) -> Column:
    """Remove URLs, then smileys."""
    return F.regexp_replace(F.regexp_replace(text, URL_PATTERN, ""), SMILEY_PATTERN, "")


def punctuation_to_space(text: Column) -> Column:
    return F.regexp_replace(text, PUNCTUATION_PATTERN, " ")


def split_words(text: Column) -> Column:
    """Lower-case pieces between white space, empty pieces included."""
    return F.split(F.lower(text), r"\s")


def is_topic_word(word: Column, letters: str = LETTERS_PATTERN, min_chars: int = MIN_TOKEN_CHARS,
                  stop_words: list[str] = STOP_WORDS) -> Column:
    """Long enough, letters only, and not a stop word."""
    return (F.length(word) >= min_chars) & word.rlike(letters) & ~word.isin(*stop_words)


def topic_words(text: Column, **rule) -> Column:
    """Array of the words of ``text`` that count for topics; works on one document without exploding it."""
    return F.filter(split_words(text), lambda word: is_topic_word(word, **rule))


def hashtags(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda word: word.startswith("#"))


def contains_any(text: Column, words: list[str]) -> Column:
    condition = F.lit(False)
    for word in words:
        condition = condition | F.contains(text, F.lit(word))
    return condition


def format_timestamp(moment: Column) -> Column:
    return F.date_format(moment, TIMESTAMP_FORMAT)
