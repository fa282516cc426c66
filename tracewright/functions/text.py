"""Text expressions: white space, tokens, stems, similarity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values
FACT_STOPWORDS = ["the", "a", "an", "is", "are", "at", "in", "of", "to", "ve", "vf", "rf"]
RANKING_STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "does", "for", "from", "in", "is", "it", "of", "on", "or", "the",
    "this", "to", "what", "when", "where", "which", "who", "with",
]
ROUTE_STOPWORDS = ["a", "an", "and", "at", "for", "from", "in", "is", "of", "on", "or", "the", "this", "to", "what", "where", "which", "who", "with"]
FACT_SUFFIXES = ["ies", "ing", "ed", "es", "s"]
QUERY_SUFFIXES = ["ing", "ers", "ies", "ed", "es", "s"]


def compress(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "), r"^ | $", "")


def normalise(text: Column) -> Column:
    return F.lower(compress(text))


def one_line(text: Column, most: int) -> Column:
    """White space compressed, cut to ``most`` characters with an ellipsis."""
    flat = compress(text)
    return F.when(F.char_length(flat) <= most, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…")))


def safe_name(text: Column, most: int = 120) -> Column:
    """A file name: other characters than letters, digits, dot, dash and underscore become underscores."""
    return F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9._-]+", "_"), 1, most)


def stem(token: Column, suffixes: list[str], ies_to_y: bool = False) -> Column:
    """The first suffix that leaves more than three letters is cut."""
    out = token
    for suffix in reversed(suffixes):
        cut = F.substring(token, F.lit(1), F.length(token) - len(suffix))
        if ies_to_y and suffix == "ies":
            cut = F.concat(cut, F.lit("y"))
        out = F.when(token.endswith(suffix) & (F.length(token) > len(suffix) + 3), cut).otherwise(out)
    return out


def fact_tokens(text: Column) -> Column:
    """Distinct stemmed [a-z0-9]+ tokens without stopwords and long hex digests, sorted."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    words = F.filter(words, lambda t: ~t.isin(FACT_STOPWORDS) & ~t.rlike("^[0-9a-f]{12,}$"))
    return F.array_sort(F.array_distinct(F.transform(words, lambda t: stem(t, FACT_SUFFIXES, True))))


def query_tokens(text: Column) -> Column:
    """Distinct stemmed words of two or more characters without stopwords, sorted."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"((?U)\w+)"), 1)
    words = F.filter(words, lambda t: (F.length(t) > 1) & ~t.isin(ROUTE_STOPWORDS))
    return F.array_sort(F.array_distinct(F.transform(words, lambda t: stem(t, QUERY_SUFFIXES))))


def ranking_tokens(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"((?U)\w+)"), 1)
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) > 1) & ~t.isin(RANKING_STOPWORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct tokens; 1 where both are empty, 0 where one is."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def goal_score(text: Column, goal: Column) -> Column:
    """8 * coverage + 2 * density + 4 for each quoted phrase of the goal that the text holds."""
    own, wanted = ranking_tokens(text), ranking_tokens(goal)
    both = F.size(F.array_intersect(wanted, own)).cast("double")
    phrases = F.regexp_extract_all(F.coalesce(goal, F.lit("")), F.lit('"([^"]{3,})"'), 1)
    held = F.size(F.filter(phrases, lambda p: F.contains(F.lower(text), F.lower(p)))).cast("double")
    return 8.0 * both / F.greatest(F.size(wanted), F.lit(1)) + 2.0 * both / F.greatest(F.size(own), F.lit(1)) + 4.0 * held


def occurrences(text: Column, term: Column) -> Column:
    """How often a non-empty term occurs in a text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")
