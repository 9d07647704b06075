"""Text cleaning and tokenising as native column expressions (TXT1-TXT14).

Every step is a JVM expression (``regexp_replace``, ``split``, higher-order
``filter``), so cleaning stays inside whole-stage codegen and never ships rows
to Python.  The character classes are spelled out because Java's ``\\w`` and
``\\s`` are ASCII-only while the rules being matched treat letters, digits and
white space in the Unicode sense.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's (stated as text, natural order)
# ---------------------------------------------------------------------------
# Words never removed as stop words.
DOMAIN_WORDS = [
    "not", "no", "never", "against", "war", "peace",
    "trump", "biden", "ukraine", "russia", "nato",
    "election", "vote", "democrat", "republican",
]
# Stop words used when no stop-word table is supplied (fallback mode).
FALLBACK_STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from",
    "has", "he", "in", "is", "it", "its", "of", "on", "that", "the",
    "to", "was", "were", "will", "with",
]
# Tokens shorter than this are dropped (the rule keeps length > 2).
MIN_TOKEN_LEN = 3

# ---------------------------------------------------------------------------
# Patterns (Java regex; the same strings run unchanged on RE2)
# ---------------------------------------------------------------------------
# Unicode white space as understood by the cleaning rule.
WS = r"\t-\r\x1c-\x1f \x{85}\p{Z}"
# Unicode word characters.
WORD = r"\p{L}\p{N}_"
# White space that can remain once the text is ASCII.
ASCII_WS = r"\t-\r\x1c-\x20"

URL_RE = rf"(http|www|https)[^{WS}]+"
MENTION_RE = rf"@[{WORD}]+"
HASHTAG_RE = rf"#([{WORD}]+)"
LEADING_RT_RE = rf"^RT[{WS}]+"
NON_ASCII_RE = r"[^\x00-\x7F]"
# Runs of non-letters become one space (the collapse below would merge the
# spaces anyway; matching runs instead of single characters is much cheaper).
NON_LETTER_RE = rf"[^a-zA-Z{ASCII_WS}]+"
# Collapse white space: only runs of two or more, or a single non-space white
# space character, need rewriting - a lone space already is the result.
ASCII_WS_RUN_RE = rf"[{ASCII_WS}]{{2,}}|[\t-\r\x1c-\x1f]"
UNICODE_TRIM_RE = rf"^[{WS}]+|[{WS}]+$"
LEADING_RT_WORD_RE = rf"^RT[{WS}]"

# Contractions split by a word tokenizer on letters-only, lower-case text
# (applied only in lexical mode).  Python-style group references.
CONTRACTIONS = [
    (r"\b(can)(not)\b", "$1 $2"),
    (r"\b(gim)(me)\b", "$1 $2"),
    (r"\b(gon)(na)\b", "$1 $2"),
    (r"\b(got)(ta)\b", "$1 $2"),
    (r"\b(lem)(me)\b", "$1 $2"),
    (r"\b(wan)(na)(?= )", "$1 $2"),
]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_urls(c) -> Column:
    """TXT2: drop ``http…``/``www…`` runs up to the next white space."""
    return F.regexp_replace(_col(c), URL_RE, "")


def strip_mentions(c) -> Column:
    """TXT3: drop ``@name``."""
    return F.regexp_replace(_col(c), MENTION_RE, "")


def unwrap_hashtags(c) -> Column:
    """TXT4: ``#word`` -> ``word``."""
    return F.regexp_replace(_col(c), HASHTAG_RE, "$1")


def strip_leading_rt(c) -> Column:
    """TXT5: ``RT`` + white space at the very start of the text only."""
    return F.regexp_replace(_col(c), LEADING_RT_RE, "")


def drop_non_ascii(c) -> Column:
    """TXT6: non-ASCII characters are deleted, not replaced."""
    return F.regexp_replace(_col(c), NON_ASCII_RE, "")


def _ascii_letter_map() -> tuple[str, str]:
    """(from, to) for ``translate`` on ASCII text: upper -> lower case, every
    character that is neither a letter nor white space -> space."""
    src, dst = [], []
    for code in range(128):
        ch = chr(code)
        if "A" <= ch <= "Z":
            src.append(ch)
            dst.append(ch.lower())
        elif not ("a" <= ch <= "z") and not (9 <= code <= 13 or 28 <= code <= 32):
            src.append(ch)
            dst.append(" ")
    return "".join(src), "".join(dst)


_ASCII_FROM, _ASCII_TO = _ascii_letter_map()


def letters_only(c) -> Column:
    """TXT7 + TXT8 on ASCII text (after TXT6): non-letters -> space, lower
    case, collapse runs, trim.

    The first two are a fixed character mapping once the text is ASCII, so one
    ``translate`` does both in a single pass (several times cheaper than a
    regex replacement plus ``lower``); equivalent to replacing
    :data:`NON_LETTER_RE` with a space and lower-casing.
    """
    x = F.translate(_col(c), _ASCII_FROM, _ASCII_TO)
    return F.trim(F.regexp_replace(x, ASCII_WS_RUN_RE, " "))


def clean_text(c) -> Column:
    """TXT1-TXT8 in order.  ``null`` becomes the empty string."""
    x = F.coalesce(_col(c), F.lit(""))
    x = strip_urls(x)
    x = strip_mentions(x)
    x = unwrap_hashtags(x)
    x = strip_leading_rt(x)
    x = drop_non_ascii(x)
    return letters_only(x)


def guard_text(df: DataFrame, name: str) -> Column:
    """TXT1 type guard: a non-string column cleans to the empty string."""
    if isinstance(df.schema[name].dataType, StringType):
        return F.col(name)
    return F.lit("")


def split_contractions(c) -> Column:
    """Word-tokenizer contraction splits (lexical mode only)."""
    x = _col(c)
    for pat, rep in CONTRACTIONS:
        x = F.regexp_replace(x, pat, rep)
    return x


def split_words(c) -> Column:
    """TXT9 (fallback mode): white-space split of cleaned text, empties dropped."""
    return F.filter(F.split(_col(c), " "), lambda t: F.length(t) > 0)


def stop_word_list(stop_words=None, keep=DOMAIN_WORDS) -> list[str]:
    """TXT10 / SET2: stop words minus the protected domain words (a set)."""
    base = FALLBACK_STOP_WORDS if stop_words is None else list(stop_words)
    keep_set = set(keep)
    seen, out = set(), []
    for w in base:
        if w not in keep_set and w not in seen:
            seen.add(w)
            out.append(w)
    return out


def filter_tokens(tokens, stop_words: list[str], min_len: int = MIN_TOKEN_LEN) -> Column:
    """TXT11: drop stop words and tokens shorter than ``min_len``.

    ``isin`` over more than ten literals is planned as a hash-set probe.
    """
    stop = list(stop_words)
    if stop:
        return F.filter(_col(tokens), lambda t: (~t.isin(stop)) & (F.length(t) >= min_len))
    return F.filter(_col(tokens), lambda t: F.length(t) >= min_len)


def tokens_of_clean(c, stop_words=None, keep=DOMAIN_WORDS) -> Column:
    """Filtered token array of a text that is cleaned already."""
    return filter_tokens(split_words(c), stop_word_list(stop_words, keep))


def tokenize(c, stop_words=None, keep=DOMAIN_WORDS, lexical: bool = False) -> Column:
    """Cleaned text -> filtered token array (before lemmatising)."""
    x = clean_text(c)
    if lexical:
        x = split_contractions(x)
    return filter_tokens(split_words(x), stop_word_list(stop_words, keep))


def clean_and_tokenize(c, stop_words=None, keep=DOMAIN_WORDS, lexical: bool = False) -> Column:
    """TXT1-TXT13 in fallback mode: space-joined tokens (a string)."""
    return F.array_join(tokenize(c, stop_words, keep, lexical), " ")


def join_tokens(tokens) -> Column:
    """TXT13."""
    return F.array_join(_col(tokens), " ")


def token_count(c) -> Column:
    """Number of white-space separated words of a text (0 for blank/null)."""
    x = F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), rf"[{WS}]+", " "))
    # the text is named once: it may be a whole cleaning chain
    return F.size(F.array_remove(F.split(x, " "), "")).cast("long")


def once(c) -> Column:
    """``c`` as a generated column: filters on it and expressions over it read its value,
    where the optimizer would put the expression itself, to be worked out for each."""
    return F.explode_outer(F.array(_col(c)))


def unicode_trim(c) -> Column:
    """``str.strip()`` semantics (Unicode white space)."""
    return F.regexp_replace(_col(c), UNICODE_TRIM_RE, "")
