"""Text expressions: tokens, snippets, sentinels, cuts, keywords and summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from presslens.schemas import MISSING

# Title words left out of term counts.
STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "is", "was", "are", "were", "be", "been",
    "has", "have", "had", "will", "would", "could", "should", "may", "might",
    "it", "its", "this", "that", "these", "those", "he", "she", "they",
    "we", "you", "i", "my", "his", "her", "their", "our", "your",
    "as", "if", "not", "no", "so", "up", "out", "about", "also", "than",
    "after", "before", "said", "says", "say", "new", "one", "two", "year",
    "years", "per", "cent", "news", "report", "reports", "day", "time",
    "how", "who", "what", "when", "why", "where", "more", "less", "all",
    "just", "over", "into", "while", "amid", "under",
]

WORD_RE = "[a-z]{3,}"
LETTERS_RE = r"[\p{L}\p{M}]{3,}"
SENTENCE_RE = r"[^.!?\n]+[.!?]*"

SNIPPET_BODY_CHARS = 500


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute ``value`` once and use it many times inside ``body``.

    A plain Column used inside a lambda may be inlined there and computed again
    for every element; a lambda variable never is.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def not_stopword(word: Column) -> Column:
    return ~word.isin(STOPWORDS)


def title_words(title: Column) -> Column:
    """Lower-case runs of three or more letters, stopwords still in."""
    return all_matches(F.lower(title), WORD_RE)


def title_tokens(title: Column) -> Column:
    """Title words without stopwords; order and repeats kept."""
    return F.filter(title_words(title), not_stopword)


def scoring_snippet(title: Column, text: Column, body_chars: int = SNIPPET_BODY_CHARS) -> Column:
    """``title. body`` with the body's first characters, or the title alone."""
    title = F.coalesce(title, F.lit(""))
    text = F.coalesce(text, F.lit(""))
    return F.when(
        (text != "") & (text != MISSING),
        F.concat(title, F.lit(". "), F.substring(text, 1, body_chars)),
    ).otherwise(title)


def or_null(value: Column) -> Column:
    """Empty text becomes NULL."""
    return let(value, lambda v: F.when(v != "", v))


def or_missing(value: Column) -> Column:
    """NULL and empty text become ``N/A``."""
    return let(value, lambda v: F.when(v != "", v).otherwise(F.lit(MISSING)))


def joined_or_missing(values: Column) -> Column:
    """Comma-joined list; ``N/A`` for an empty or NULL list."""
    return let(values, lambda v: F.when(F.size(v) > 0, F.array_join(v, ", ")).otherwise(
        F.lit(MISSING)
    ))


def cut(value: Column, chars: int) -> Column:
    return F.substring(value, 1, chars)


def cut_with_dots(value: Column, chars: int) -> Column:
    """Cut text, with ``...`` only where something was cut."""
    dots = F.when(F.length(value) > chars, F.lit("...")).otherwise(F.lit(""))
    return F.concat(F.substring(value, 1, chars), dots)


def _ranked_terms(words: Column) -> Column:
    """Distinct words with counts, most frequent first, ties by word.

    Runs of equal words in the sorted list are counted by the distance between
    run starts: no shuffle, no per-document group.
    """

    def runs(ordered: Column) -> Column:
        positions = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return let(positions, lambda starts: F.transform(
            starts,
            lambda start, j: F.struct(
                (start - F.coalesce(F.get(starts, j + 1), F.size(ordered))).alias("neg_n"),
                F.get(ordered, start).alias("term"),
            ),
        ))

    empty = F.array().cast("array<struct<neg_n:int,term:string>>")
    return let(F.sort_array(words), lambda ordered: F.when(
        F.size(ordered) > 0, F.sort_array(runs(ordered))
    ).otherwise(empty))


def content_words(text: Column) -> Column:
    """Lower-case words of three or more letters of any script, no stopwords."""
    return F.filter(all_matches(F.lower(text), LETTERS_RE), not_stopword)


def ranked_keywords(text: Column, k: int = 10) -> Column:
    """Array of the ``k`` most frequent words as ``(neg_n, term)``."""
    return F.slice(_ranked_terms(content_words(text)), 1, k)


def keywords(text: Column, k: int = 10) -> Column:
    """The ``k`` most frequent words, comma-joined; ``N/A`` without any."""
    return joined_or_missing(F.transform(ranked_keywords(text, k), lambda t: t["term"]))


def summary(text: Column, sentences: int = 5, k: int = 10) -> Column:
    """The highest-scoring sentences, in their original order.

    A sentence scores the sum, over its words that are among the text's ``k``
    keywords, of that keyword's count in the whole text: a summariser that scores by
    keywords reads the same ``k`` that it shows, and a sentence of many rare words
    does not win by length. Ties go to the earlier sentence. Empty text gives ``N/A``.
    """

    def score(sentence: Column, counts: Column) -> Column:
        return F.aggregate(
            all_matches(F.lower(sentence), LETTERS_RE),
            F.lit(0),
            lambda total, word: total + F.coalesce(F.try_element_at(counts, word), F.lit(0)),
        )

    stripped = F.filter(
        F.transform(all_matches(text, SENTENCE_RE), lambda s: F.trim(s)), lambda s: s != ""
    )
    neg_counts = F.map_from_entries(
        F.transform(ranked_keywords(text, k), lambda t: F.struct(t["term"], t["neg_n"]))
    )
    best = let(neg_counts, lambda counts: F.slice(
        F.sort_array(F.transform(
            stripped,
            lambda s, i: F.struct(score(s, counts).alias("neg_score"), i.alias("i"), s.alias("s")),
        )),
        1,
        sentences,
    ))
    in_order = F.sort_array(F.transform(best, lambda b: F.struct(b["i"], b["s"])))
    return or_missing(F.array_join(F.transform(in_order, lambda b: b["s"]), " "))
