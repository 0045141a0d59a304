"""Column functions on text: tokens, n-grams, character classes, cleaning."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that define tokens and character classes. Explicit
# classes are used because \w, \s and \d differ between regex engines.
WORD = r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?:'[A-Za-zÀ-ÖØ-öø-ÿ]+)?"
PLAIN_WORD = r"[\p{L}\p{N}_]+"
TFIDF_TOKEN = r"[\p{L}\p{N}_][\p{L}\p{N}_]+"
DIGIT = r"\p{Nd}"
UPPER = r"[A-Z]"
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
PUNCTUATION = r"[^\p{L}\p{N}_\s\p{Z}\x1c-\x1f\x85]"
URL_OR_EMAIL = r"(?i)(?:https?://|www\.)[^\s]+|[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
HTML_TAG = r"<[^>]*>"
HTML_ENTITY = r"&(?:[a-zA-Z]+|#[0-9]+);"

# English contractions, applied in this order.
CONTRACTIONS = [
    ("won't", "will not"),
    ("can't", "can not"),
    ("n't", " not"),
    ("'re", " are"),
    ("'ve", " have"),
    ("'ll", " will"),
    ("'d", " would"),
    ("'m", " am"),
    ("let's", "let us"),
    ("it's", "it is"),
]


def tokens(text: Column) -> Column:
    """Lower-cased words of letters with an optional apostrophe part."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def plain_tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores."""
    return F.regexp_extract_all(text, F.lit(PLAIN_WORD), F.lit(0))


def tfidf_tokens(text: Column) -> Column:
    """Lower-cased runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TFIDF_TOKEN), F.lit(0))


def word_pairs(words: Column) -> Column:
    """Adjacent words as an array of structs (a, b)."""
    def pairs(w: Column) -> Column:
        n = F.greatest(F.size(w) - 1, F.lit(0))
        return F.arrays_zip(F.slice(w, F.lit(1), n).alias("a"), F.slice(w, F.lit(2), n).alias("b"))

    # binding the words to a lambda variable tokenizes each text once
    return F.get(F.transform(F.array(words), pairs), F.lit(0)).cast("array<struct<a:string,b:string>>")


def is_blank(text: Column) -> Column:
    """Empty or whitespace only."""
    return text.rlike("^" + SPACE + "*$")


def share_of(text: Column, pattern: str) -> Column:
    """Percent of a text's characters that match; 0 for a text of no length."""
    return F.coalesce(
        F.try_divide(F.regexp_count(text, F.lit(pattern)).cast("double"), F.length(text).cast("double")), F.lit(0.0)
    ) * 100.0


def stopwords(language: str = "english") -> list[str]:
    return StopWordsRemover.loadDefaultStopWords(language)


def expand_contractions(text: Column) -> Column:
    for short, long in CONTRACTIONS:
        text = F.regexp_replace(text, "(?i)" + short, long)
    return text


def tidy_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))
