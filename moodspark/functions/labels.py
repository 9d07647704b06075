"""Label and presentation expressions (PRJ2-PRJ10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from moodspark.functions.text import unicode_trim

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's
# ---------------------------------------------------------------------------
# Class index -> name.
LABEL_NAMES = ["negative", "neutral", "positive"]
# Lenient label map (string keys after strip + lower).
LABEL_MAP = {
    "negative": 0, "negatif": 0, "0": 0,
    "neutral": 1, "neutre": 1, "1": 1,
    "positive": 2, "positif": 2, "2": 2,
}
# Strict label map (exact keys).
STRICT_LABEL_MAP = {"positive": 2, "neutral": 1, "negative": 0}
# Expected-label spelling (French -> English).
EXPECTED_TO_LABEL = {"positif": "positive", "negatif": "negative", "neutre": "neutral"}
# Correct-flag words and preview sizes.
YES, NO = "Oui", "Non"
TEXT_PREVIEW_CHARS = 90
TOKENS_PREVIEW_CHARS = 80
ELLIPSIS = "..."


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _map_literal(d: dict) -> Column:
    kv = []
    for k, v in d.items():
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)


def normalise_label(c, dtype=None) -> Column:
    """PRJ2: lenient label -> int class or null.

    Strings: ``strip().lower()`` looked up in :data:`LABEL_MAP`; anything else is
    null.  Numbers and booleans: equal to 0, 1 or 2 (so ``1.0`` and ``True`` map
    to 1).
    """
    x = _col(c)
    if dtype is None or isinstance(dtype, StringType):
        key = F.lower(unicode_trim(x))
        return F.try_element_at(_map_literal(LABEL_MAP), key).cast("int")
    if isinstance(dtype, BooleanType):
        return x.cast("int")
    if isinstance(dtype, NumericType):
        return F.when(x.isin(0, 1, 2), x.cast("int"))
    return F.lit(None).cast("int")


def strict_label(c) -> Column:
    """PRJ3: exact-key map, unmapped -> null."""
    return F.try_element_at(_map_literal(STRICT_LABEL_MAP), _col(c)).cast("int")


def label_name(c) -> Column:
    """PRJ4: class index -> name (null outside 0..2)."""
    return F.try_element_at(F.array(*[F.lit(n) for n in LABEL_NAMES]), _col(c).cast("int") + 1)


def expected_label(c) -> Column:
    """PRJ5: trimmed lower-case value, French names mapped to English."""
    key = F.lower(unicode_trim(_col(c)))
    return F.coalesce(F.try_element_at(_map_literal(EXPECTED_TO_LABEL), key), key)


def text_preview(c, n: int = TEXT_PREVIEW_CHARS) -> Column:
    """PRJ6: first ``n`` characters, ``...`` only when longer."""
    x = _col(c)
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit(ELLIPSIS))).otherwise(x)


def tokens_preview(c, n: int = TOKENS_PREVIEW_CHARS) -> Column:
    """PRJ6: first ``n`` characters and ``...`` always."""
    return F.concat(F.substring(_col(c), 1, n), F.lit(ELLIPSIS))


def capitalise(c) -> Column:
    """PRJ8: first character upper, rest lower (``str.capitalize``)."""
    x = _col(c)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))


def correct_flag(expected, predicted) -> Column:
    """PRJ9."""
    return F.when(_col(expected) == _col(predicted), F.lit(YES)).otherwise(F.lit(NO))


def title_group(c) -> Column:
    """PRJ10: text before the first `` - ``."""
    return F.split(_col(c), " - ").getItem(0)


def title_name(c) -> Column:
    """PRJ10: text between the first and second `` - ``."""
    return F.split(_col(c), " - ").getItem(1)
