"""Public English stop-word list for lexical mode.

``english_stop_words.txt`` beside this module holds Spark ML's public English
list (``StopWordsRemover.loadDefaultStopWords("english")``) as it is, one word a
line; a test holds the two against each other.  Entries with an apostrophe can
never match a cleaned token (apostrophes are gone after cleaning) and are dropped.
"""

from __future__ import annotations

import functools
from importlib import resources


@functools.lru_cache(maxsize=1)
def english_stop_words() -> tuple[str, ...]:
    text = resources.files(__package__).joinpath("english_stop_words.txt").read_text(encoding="utf-8")
    return tuple(w for w in text.split() if w.isalpha())
