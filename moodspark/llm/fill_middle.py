"""Fill-in-middle transformation with a compressed set of token boundaries.

A text's tokens are runs of ASCII letters and single other code points.  The
places where a token starts, and the text's end, form a set of code point
positions kept as containers of 65,536 positions each: a sorted array where they
are few, a bitmap where they are many, runs where they stand side by side,
whichever is smallest.  Cumulative cardinalities find the container of the k-th
boundary, and a select within it gives the position; two selects are the two cuts.

Python sees a text once and returns three numbers for it; hashes, the choice of
form and the putting together of the output are column expressions.

Defined results: a null text is empty; an empty text, or one that holds a marker,
stays plain; a null id draws as an empty id does; equal ids draw the same numbers,
each of its own text; repeated rows give repeated rows; an empty table gives an
empty table; other columns are left out, whatever their names.  The memory of a
task is the batch's texts, the containers of one text and the arrays of one piece
of it (``PIECE_BYTES``), however long the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodspark.llm.common import ship, texts, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are cut, and of a hundred that are cut so many have the suffix first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
SALT = "1:"

#: Positions of a container, and the bytes of a bitmap over them.
SPAN, BITMAP_BYTES = 1 << 16, 1 << 13
#: Bytes of text whose boundaries are worked out at once.
PIECE_BYTES = 1 << 20
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.int64)


class Container:
    """Some of 65,536 positions, in the smallest of three forms."""

    __slots__ = ("kind", "data", "upto")

    def __init__(self, low: np.ndarray):
        heads = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        if 4 * len(heads) < min(2 * len(low), BITMAP_BYTES):
            self.kind, self.data = "run", low[heads].astype(np.uint16)
            self.upto = np.append(heads, len(low))
        elif 2 * len(low) <= BITMAP_BYTES:
            self.kind, self.data, self.upto = "array", low.astype(np.uint16), None
        else:
            bits = np.zeros(SPAN, np.uint8)
            bits[low] = 1
            self.kind, self.data = "bitmap", np.packbits(bits)
            self.upto = np.append(0, np.cumsum(_ONES[self.data]))

    def select(self, k: int) -> int:
        """The k-th position held, counted from 0."""
        if self.kind == "array":
            return int(self.data[k])
        at = int(np.searchsorted(self.upto, k, "right")) - 1
        if self.kind == "run":
            return int(self.data[at]) + k - int(self.upto[at])
        return 8 * at + int(np.flatnonzero(np.unpackbits(self.data[at:at + 1]))[k - int(self.upto[at])])

    def positions(self) -> np.ndarray:
        if self.kind == "array":
            return self.data.astype(np.int64)
        if self.kind == "bitmap":
            return np.flatnonzero(np.unpackbits(self.data))
        return np.repeat(self.data - self.upto[:-1], np.diff(self.upto)) + np.arange(self.upto[-1])


class BoundarySet:
    """Containers by their high 16 bits, with the number of positions before each."""

    def __init__(self, pieces: Iterable[np.ndarray]):
        """``pieces``: ascending positions, piece after piece."""
        self.high: list[int] = []
        self.containers: list[Container] = []
        before, held, now = [0], [], None

        def close() -> None:
            if held:
                low = np.concatenate(held)
                self.high.append(now)
                self.containers.append(Container(low))
                before.append(before[-1] + len(low))
                held.clear()

        for piece in pieces:
            for part in np.split(piece, np.flatnonzero(np.diff(piece >> 16)) + 1):
                if not len(part):
                    continue
                if int(part[0]) >> 16 != now:
                    close()
                    now = int(part[0]) >> 16
                held.append(part & 0xFFFF)
        close()
        self.before = np.array(before)

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return self.high[at] * SPAN + self.containers[at].select(k - int(self.before[at]))


def boundaries(data: np.ndarray, piece_bytes: int = PIECE_BYTES) -> Iterator[np.ndarray]:
    """Code point positions of token starts in UTF-8 bytes, then the text's length."""
    chars, before = 0, False
    for at in range(0, len(data), piece_bytes):
        b = data[at:at + piece_bytes]
        letter = (b | 0x20) - 97 < 26  # bytes wrap around, so that only letters are below 26
        inside = letter.copy()
        inside[1:] &= letter[:-1]
        inside[0] &= before
        lead = (b & 0xC0) != 0x80
        yield chars + np.flatnonzero(~inside[lead])
        chars += int(lead.sum())
        before = bool(letter[-1])
    yield np.array([chars], np.int64)


def cut_columns(column: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    """``n, first, second``: tokens, and the code points before each of the two cuts."""
    data, offsets = utf8(column)
    n, first, second = (np.zeros(len(column), np.int64) for _ in range(3))
    draws = zip(h1.to_pylist(), h2.to_pylist())
    for i, (x, y) in enumerate(draws):
        found = BoundarySet(boundaries(data[offsets[i]:offsets[i + 1]]))
        n[i] = len(found) - 1
        first[i], second[i] = sorted(found.select(h % (len(found))) for h in (x, y))
    return pa.StructArray.from_arrays([pa.array(n), pa.array(first), pa.array(second)], ["n", "first", "second"])


def _cuts(text: Column, h1: Column, h2: Column) -> Column:
    def cut(column: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        return cut_columns(column, h1, h2)

    return F.arrow_udf(cut, "n long, first long, second long")(text, h1, h2)


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut_percent: int = CUT_PERCENT,
              suffix_first_percent: int = SUFFIX_FIRST_PERCENT, salt: str = SALT) -> DataFrame:
    """``doc_id, text, n, form, prefix_chars, middle_chars, output``: each text as it
    goes into training, its form (plain, psm, spm) and where it was cut."""
    ship(docs.sparkSession)
    draw = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("_draw", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    plain = ((F.col("text") == "") | F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX)
             | F.col("text").contains(MIDDLE) | (h[2] % 100 >= cut_percent))
    a, b = F.col("_cut.first"), F.col("_cut.second")
    prefix = F.substring(F.col("text"), F.lit(1), a.cast("int"))
    middle = F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))
    suffix = F.substring(F.col("text"), (b + 1).cast("int"), F.length("text"))
    form = F.when(plain, "plain").when(h[3] % 100 < suffix_first_percent, "spm").otherwise("psm")
    cut = F.col("form") != "plain"
    return (texts(docs, id_col, text_col).withColumn("_draw", draw)
            .withColumn("_cut", _cuts(F.col("text"), h[0], h[1])).withColumn("form", form)
            .select("doc_id", "text", F.col("_cut.n").alias("n"), "form",
                    F.when(cut, a).alias("prefix_chars"), F.when(cut, b - a).alias("middle_chars"),
                    F.when(~cut, F.col("text"))
                    .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
                    .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).alias("output")))


def restore(output: Column, form: Column) -> Column:
    """The text again, from the output and its form alone.  No marker can arise where
    parts meet: none ends with the sign that another starts with."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    part = [F.element_at(parts, i) for i in (2, 3, 4)]
    return (F.when(form == "plain", output).when(form == "psm", F.concat(part[0], part[2], part[1]))
            .otherwise(F.concat(part[1], part[2], part[0])))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2,
  ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
n AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM u),
f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m,
  array_to_string(u[b + 1:], '') AS x FROM n)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM f
"""
