"""Token counts by byte-pair merging, without producing identifiers.

A text's symbols form a linked list; a heap holds the adjacent pairs whose
concatenation is a piece of the vocabulary, best score first and leftmost among
equals.  Popping a pair merges it and offers its two new neighbours.  The count
is the number of initial symbols less the number of merges; a symbol that is no
piece at the end weighs as many tokens as it has UTF-8 bytes (byte fallback).

No piece of the vocabulary holds a word mark after another character, so no
merge crosses such a place: the text falls into segments there, each counted on
its own.  Segments repeat, so a task remembers counts (bounded memory).  When a
vocabulary does hold such pieces, texts are counted whole.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows
and null ids give one row each; an empty table gives an empty table; other
columns are ignored.  Texts are whole: the heap is O(n log n) in a segment.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from moodspark.llm.common import map_arrow, texts

MARK = "▁"
#: Segments whose counts a task remembers; beyond it the memory starts anew.
REMEMBERED = 600_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class PieceCounter:
    """Counts tokens of texts by the pieces and scores of a sentencepiece model."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        ids = [i for i in range(model.get_piece_size())
               if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        # a heap pops the smallest, so the best (highest) score ranks lowest
        self.rank = {model.id_to_piece(i): -model.get_score(i) for i in ids}
        self.normalise = model.normalize
        # the plain case: spaces become marks and one mark goes in front
        probe = "  a ﬁ ①\tb\n "
        self.plain = model.normalize(probe) == MARK + probe.replace(" ", MARK)
        self.by_segment = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.rank)
        self.known: dict[str, int] = {}

    def merge_count(self, segment: str) -> int:
        rank = self.rank
        n = len(segment)
        if n < 2:
            return 0 if not n else 1 if segment in rank else len(segment.encode())
        symbol = list(segment)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(segment[i:i + 2])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, left, length = heapq.heappop(heap)
            if not symbol[left] or (right := after[left]) < 0 or len(symbol[left]) + len(symbol[right]) != length:
                continue  # one of the two has been merged meanwhile
            symbol[left] += symbol[right]
            symbol[right] = ""
            merges += 1
            after[left] = nxt = after[right]
            if nxt >= 0:
                before[nxt] = left
                both = symbol[left] + symbol[nxt]
                if (r := rank.get(both)) is not None:
                    heapq.heappush(heap, (r, left, len(both)))
            if (prev := before[left]) >= 0:
                both = symbol[prev] + symbol[left]
                if (r := rank.get(both)) is not None:
                    heapq.heappush(heap, (r, prev, len(both)))
        fallback = sum(len(s.encode()) - 1 for s in symbol if s and s not in rank)
        return n - merges + fallback

    def count(self, text: str) -> int:
        if not text:
            return 0
        whole = MARK + text.replace(" ", MARK) if self.plain and "\0" not in text else self.normalise(text)
        if not self.by_segment:
            return self.merge_count(whole)
        known, total = self.known, 0
        # a segment ends where a mark follows another character
        for segment, times in Counter(re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", whole)).items():
            n = known.get(segment)
            if n is None:
                n = self.merge_count(segment)
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(segment) <= 64:
                    known[segment] = n
            total += n * times
        return total


@lru_cache(maxsize=2)
def counter_of(model_path: str) -> PieceCounter:
    """One counter for all tasks of a Python worker, with what it remembers."""
    return PieceCounter(model_path)


def count_tokens(df: DataFrame, model_path: str, limit: int = 4096,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(model_path)
        for batch in batches:
            column = [t or "" for t in batch.column(1).to_pylist()]
            n = [counter.count(t) for t in column]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in column], pa.int64()),
                 pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(texts(df, id_col, text_col), run, SCHEMA)
