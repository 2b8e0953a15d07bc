"""Text primitives as column expressions. Patterns hold for Java's and RE2's regular expressions alike.

Blank characters are all that Unicode calls white space, spelled out, as neither engine's ``\\s`` has them by default.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"\t-\r\x1c-\x20" + "\x85\xa0  -     　"
B = f"[{BLANKS}]"
#: Flags in front of a pattern whose ^ and $ mean lines, ended by \n only.
LINES_JAVA, LINES_RE2 = "(?md)", "(?m)"

# Words without weight in comparisons.
STOP_WORDS = ["the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "and", "or", "but", "not", "no", "this", "that", "it", "its", "has", "had", "have", "do", "does", "did", "will", "would", "shall", "should", "may", "might", "can", "could", "about", "over", "into"]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    return F.regexp_replace(c, f"^{B}+|{B}+$", "")


def tokens(c: str | Column) -> Column:
    """Tokens between blanks."""
    return F.filter(F.split(c, f"{B}+"), lambda t: t != "")


def token_count(c: str | Column) -> Column:
    return F.coalesce(F.size(tokens(c)), F.lit(0))


def content_hash(c: str | Column) -> Column:
    return F.sha2(strip(c), 256)


def title(c: str | Column) -> Column:
    """Upper case after every character that is no letter, lower case after letters."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(0)), lambda x: F.initcap(x)), "")


def squeeze(c: str | Column) -> Column:
    return F.regexp_replace(strip(c), f"{B}+", " ")


def word_set(c: str | Column) -> Column:
    """Distinct lower-case runs of ASCII letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))


def overlap(a: str | Column, b: str | Column) -> Column:
    """The share of a's words, without stop words, that b has; 0 if a has none."""
    stop = F.array(*(F.lit(w) for w in STOP_WORDS))
    x = F.array_except(word_set(a), stop)
    y = F.array_except(word_set(b), stop)
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x)).otherwise(F.lit(0.0))


def weighty_words(c: str | Column) -> Column:
    """The words of a text that count in ``overlap``."""
    return F.array_except(word_set(c), F.array(*(F.lit(w) for w in STOP_WORDS)))


def overlap_of(words: str | Column, b: str | Column) -> Column:
    """``overlap`` of a text whose ``weighty_words`` are at hand, so that they aren't made again for each b."""
    x = col(words)
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, word_set(b))) / F.size(x)).otherwise(F.lit(0.0))


def ascii_words(c: str | Column) -> Column:
    """Letters and digits beyond ASCII become ``_``, so that ASCII word boundaries fall where Unicode's would."""
    return F.regexp_replace(c, r"[^\P{L}\x00-\x7F]|[^\P{N}\x00-\x7F]", "_")


def first_sentences(c: str | Column, n: int) -> Column:
    """The first n sentences, ended by a full stop if they have no end mark."""
    s = F.filter(F.split(strip(c), rf"(?<=[.!?]){B}+"), lambda x: x != "")
    joined = F.array_join(F.slice(s, 1, n), " ")
    return F.when((joined == "") | joined.rlike(r"[.!?]$"), joined).otherwise(F.concat(joined, F.lit(".")))


# The same in DuckDB's SQL, for comparison.


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{B}+|{B}+$', '', 'g')"


def sql_tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{B}+'), lambda t: t <> '')"


def sql_hash(c: str) -> str:
    return f"sha256({sql_strip(c)})"


def sql_words(c: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]+'))"


def sql_ascii_words(c: str) -> str:
    return rf"regexp_replace({c}, '[^\P{{L}}\x00-\x7F]|[^\P{{N}}\x00-\x7F]', '_', 'g')"


def sql_overlap(a: str, b: str) -> str:
    stop = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
    x = f"list_filter({sql_words(a)}, lambda w: NOT list_contains({stop}, w))"
    y = f"list_filter({sql_words(b)}, lambda w: NOT list_contains({stop}, w))"
    return f"CASE WHEN len({x}) > 0 THEN len(list_intersect({x}, {y})) / len({x}) ELSE 0.0 END"
