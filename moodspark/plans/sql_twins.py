"""SQL builders for the DuckDB twins of the catalogue queries.

The same pattern constants as the Spark expressions are used (RE2 accepts them
unchanged); only the replacement syntax (``\\1`` instead of ``$1``) and the
lambda syntax differ.
"""

from __future__ import annotations

from moodspark.functions import text as T
from moodspark.functions.labels import EXPECTED_TO_LABEL, LABEL_MAP, LABEL_NAMES


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def clean(x: str) -> str:
    x = f"coalesce({x}, '')"
    x = f"regexp_replace({x}, {q(T.URL_RE)}, '', 'g')"
    x = f"regexp_replace({x}, {q(T.MENTION_RE)}, '', 'g')"
    x = f"regexp_replace({x}, {q(T.HASHTAG_RE)}, '\\1', 'g')"
    x = f"regexp_replace({x}, {q(T.LEADING_RT_RE)}, '')"
    x = f"regexp_replace({x}, {q(T.NON_ASCII_RE)}, '', 'g')"
    x = f"lower(regexp_replace({x}, {q(T.NON_LETTER_RE)}, ' ', 'g'))"
    return f"trim(regexp_replace({x}, {q(T.ASCII_WS_RUN_RE)}, ' ', 'g'))"


def tokens(x: str, stop=None) -> str:
    """Filtered token list of raw text ``x`` (fallback mode)."""
    stop = T.stop_word_list(stop)
    words = f"list_filter(string_split({clean(x)}, ' '), lambda t: length(t) > 0)"
    return (f"list_filter({words}, lambda t: NOT list_contains({sql_list(stop)}, t) "
            f"AND length(t) >= {T.MIN_TOKEN_LEN})")


def token_string(x: str) -> str:
    return f"array_to_string({tokens(x)}, ' ')"


def unicode_trim(x: str) -> str:
    return f"regexp_replace({x}, {q(T.UNICODE_TRIM_RE)}, '', 'g')"


def token_count(x: str) -> str:
    t = f"trim(regexp_replace(coalesce({x}, ''), {q('[' + T.WS + ']+')}, ' ', 'g'))"
    return f"(CASE WHEN {t} = '' THEN 0 ELSE len(string_split({t}, ' ')) END)::BIGINT"


def label_normalise(x: str) -> str:
    key = f"lower({unicode_trim(x)})"
    whens = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in LABEL_MAP.items())
    return f"(CASE {key} {whens} ELSE NULL END)::INTEGER"


def label_name(x: str) -> str:
    return f"{sql_list(LABEL_NAMES)}[({x}) + 1]"


def expected_label(x: str) -> str:
    key = f"lower({unicode_trim(x)})"
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in EXPECTED_TO_LABEL.items())
    return f"(CASE {key} {whens} ELSE {key} END)"


# Views over the driver tables shared by many twins --------------------------

TWEETS = (
    "tweets AS (SELECT doc_id, source, lang, text, "
    "(CASE WHEN lang = 'en' THEN 'RT @' ELSE '@' END) || source || ' ' || text || ' #' || lang "
    "|| 'x https://h.t/' || CAST(doc_id AS VARCHAR) AS tweet FROM documents)"
)

LABELLED = (
    "labelled AS (SELECT d.doc_id, d.source, d.text, "
    "(CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 THEN 2 ELSE 1 END)::INTEGER AS label "
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
)


def _raw_label_sql() -> str:
    from moodspark.sources.tables import RAW_LABEL_SPELLINGS
    whens = " ".join(f"WHEN {c} THEN {sql_list(w)}[(d.doc_id % 5) + 1]" for c, w in RAW_LABEL_SPELLINGS.items())
    return (
        "raw AS (SELECT d.doc_id, d.source, d.text AS content, "
        f"(CASE (CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 THEN 2 WHEN l.doc_id IS NOT NULL THEN 1 END) "
        f"{whens} ELSE NULL END) AS class "
        "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
    )


RAW = _raw_label_sql()


def argmax(s: str) -> str:
    return f"(list_position({s}, list_max({s})) - 1)::INTEGER"


def class_rank_cte(src: str, name: str = "ranked", seed: int = 42) -> str:
    """Exact per-class hash rank (the Spark side computes it by buckets)."""
    return (
        f"{name} AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY "
        f"md5('{seed}|' || CAST(doc_id AS VARCHAR)), doc_id) AS rnk, "
        f"count(*) OVER (PARTITION BY label) AS class_n FROM {src})"
    )


SPLIT_EXPR = ("(CASE WHEN rnk * 10 <= class_n * 7 THEN 'train' "
              "WHEN rnk * 20 <= class_n * 17 THEN 'val' ELSE 'test' END)")
