"""LAB1 with all valence rules: capitals, boosters, negations, "but" clauses, idioms, "!" and "?".

The published method (valence-aware lexicon scoring, Hutto & Gilbert 2014) on raw
texts, since case and punctuation count.  The lexicon ``(word, valence)``, the idioms
``(idiom, valence)`` and the context words are the user's.

Words and their context (three words before, one after, case, the side of "but") are
built row-locally, and only words that the lexicon or an idiom holds leave the row, to
meet their valence in a join and be summed by document: one shuffle of short partial
sums.  Idioms are matched by one expression that is a trie of their words, from left
to right, the longest first; a matched idiom is one word with the idiom's valence.
The lexicon's words go into the plan as a set (``MAX_WORDS`` at most).

Defined results: a null text is empty; a text without a word of the lexicon scores 0;
a word is stripped of punctuation around it if more than two characters are left.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodspark.operators import lexicon
from moodspark.operators.joins import collect_bounded

# ---------------------------------------------------------------------------
# Fixed values (constants of the published method)
# ---------------------------------------------------------------------------
CAPITALS = 0.733
EXCLAMATION, MOST_EXCLAMATIONS = 0.292, 4
QUESTION, MOST_QUESTIONS, MANY_QUESTIONS = 0.18, 3, 0.96
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
NEVER_NEAR, NEVER_FAR = 1.5, 1.25

MAX_WORDS = 50_000
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Stands between the words of an idiom that was matched.
JOIN = "_"
SPACE = r"[ \t\n\x0B\f\r]"


@dataclass
class Context:
    """The words that change a valence; lower case."""

    boosters: dict[str, float] = field(default_factory=lambda: (
        {w: lexicon.BOOST for w in lexicon.INTENSIFIERS} | {w: -lexicon.BOOST for w in lexicon.DAMPENERS}))
    negators: tuple[str, ...] = tuple(lexicon.NEGATORS)
    never: tuple[str, ...] = ("never",)
    stress: tuple[str, ...] = ("so", "this")
    but: tuple[str, ...] = ("but",)


def idiom_pattern(idioms: list[str]) -> str | None:
    """One expression for all idioms: a trie of their words, each level's longest way first."""
    trie: dict = {}
    for idiom in idioms:
        at = trie
        for w in idiom.lower().split():
            at = at.setdefault(w, {})
        at[None] = True

    def ways(at: dict) -> str:
        out = []
        for w in sorted(k for k in at if k is not None):
            below = ways(at[w])
            optional = "?" if None in at[w] else ""
            out.append(re.escape(w) + (f"(?:{SPACE}+{below}){optional}" if below else ""))
        return f"(?:{'|'.join(out)})" if out else ""

    return rf"\b{ways(trie)}\b" if trie else None


def words(text: Column, pattern: str | None) -> Column:
    """The words of a text; a matched idiom is one word, its spaces turned into ``JOIN``."""
    def split(part: Column) -> Column:
        bare = F.transform(F.split(part, f"{SPACE}+"), lambda w: F.struct(w.alias("w"), F.btrim(w, F.lit(PUNCTUATION)).alias("b")))
        return F.transform(F.filter(bare, lambda s: s["w"] != ""), lambda s: F.when(F.length(s["b"]) > 2, s["b"]).otherwise(s["w"]))

    if pattern is None:
        return split(text)
    folded = f"(?i){pattern}"
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({folded})"), F.lit(1)),
                        lambda w: F.array(F.regexp_replace(w, f"{SPACE}+", JOIN)))
    parts = F.transform(F.split(text, folded, -1), split)
    return F.flatten(F.zip_with(parts, found, lambda p, i: F.concat(p, F.coalesce(i, F.array().cast("array<string>")))))


def _is(word: Column, among) -> Column:
    return F.coalesce(F.lower(word).isin(list(among)), F.lit(False)) if among else F.lit(False)


def _upper(word: Column) -> Column:
    return (F.upper(word) == word) & (F.lower(word) != word)


def punctuation(text: Column) -> Column:
    marks = F.least(F.regexp_count(text, F.lit("!")), F.lit(MOST_EXCLAMATIONS)) * EXCLAMATION
    asked = F.regexp_count(text, F.lit(r"\?"))
    return marks + F.when(asked <= 1, 0.0).when(asked <= MOST_QUESTIONS, asked * QUESTION).otherwise(MANY_QUESTIONS)


def _step(words_: Column, i: Column, k: int, known: list[str], context: Context, shouted: Column) -> Column:
    """What the word ``k`` places before the ``i``-th (from 0) does to its valence."""
    at = [F.when(i >= j, F.try_element_at(words_, (i + 1 - j).cast("int"))) for j in (1, 2, 3)]
    w = at[k - 1]
    boosts = F.create_map(*[F.lit(x) for kv in context.boosters.items() for x in kv]) if context.boosters else None
    boost = F.coalesce(F.try_element_at(boosts, F.lower(w)), F.lit(0.0)) if boosts is not None else F.lit(0.0)
    turns = F.when(_is(w, context.negators), lexicon.NEGATION_SCALAR).otherwise(1.0)
    if k > 1:
        near = _is(at[0], context.stress) if k == 2 else _is(at[1], context.stress) | _is(at[0], context.stress)
        turns = F.when(_is(w, context.never) & near, NEVER_NEAR if k == 2 else NEVER_FAR).otherwise(turns)
    # a word that has a valence of its own isn't context
    idle = w.isNull() | _is(w, known)
    return F.struct(F.when(idle, 0.0).otherwise(boost * lexicon.DECAY[k - 1]).alias("boost"),
                    F.when(~idle & (boost != 0) & _upper(w) & shouted, CAPITALS * lexicon.DECAY[k - 1]).otherwise(0.0).alias("loud"),
                    F.when(idle, 1.0).otherwise(turns).alias("turns"))


def _once(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _turned(valence: Column, steps: Column) -> Column:
    """Steps from the nearest word on, each on what the one before left."""
    return F.aggregate(steps, valence, lambda v, s: (
        v + F.when(v < 0, -s["boost"]).otherwise(s["boost"]) + F.when(v > 0, s["loud"]).otherwise(-s["loud"])) * s["turns"])


def valence_score(df: DataFrame, id_col: str, text_col: str, lexicon_words: DataFrame, idioms: DataFrame | None = None,
                  context: Context | None = None, max_words: int = MAX_WORDS) -> DataFrame:
    """LAB1: ``(id, sentiment_score)`` for every row of ``df`` (unique ids)."""
    context = context or Context()
    listed = [r[0].lower() for r in collect_bounded(lexicon_words.select("word"), max_words, "words of the lexicon")]
    phrases = [r[0] for r in collect_bounded(idioms.select("idiom"), max_words, "idioms")] if idioms is not None else []
    table = lexicon_words.select(F.lower("word").alias("word"), F.col("valence").cast("double").alias("valence"))
    if idioms is not None:
        table = table.unionByName(idioms.select(F.regexp_replace(F.lower(F.trim("idiom")), r"\s+", JOIN).alias("word"),
                                                F.col("valence").cast("double").alias("valence")))
    known = listed + [JOIN.join(p.lower().split()) for p in phrases]
    text = F.coalesce(F.col(text_col), F.lit(""))

    def about(w: Column) -> Column:
        """The words with what is so for the whole text."""
        loud = F.size(F.filter(w, _upper))
        first = [F.nullif(F.array_position(F.transform(w, F.lower), b), F.lit(0)) for b in context.but]
        return F.struct(w.alias("w"), ((loud > 0) & (loud < F.size(w))).alias("shouted"),
                        (F.coalesce(*first, F.lit(0)) - 1 if first else F.lit(-1)).alias("but"))

    def hits(c: Column) -> Column:
        w, shouted, but = c["w"], c["shouted"], c["but"]
        found = F.filter(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
                         lambda s: _is(s["x"], known) & ~_is(s["x"], context.boosters))
        return F.transform(found, lambda s: F.struct(
            F.lower(s["x"]).alias("word"),
            F.when(_upper(s["x"]) & shouted, CAPITALS).otherwise(0.0).alias("loud"),
            F.when((but < 0) | (s["i"] == but), 1.0).when(s["i"] < but, BEFORE_BUT).otherwise(AFTER_BUT).alias("side"),
            F.array(*[_step(w, s["i"], k, known, context, shouted) for k in (1, 2, 3)]).alias("steps")))

    # a lambda's variable is worked out once a row, whatever uses it
    rows = df.select(F.col(id_col), punctuation(text).alias("_marks"),
                     _once(_once(words(text, idiom_pattern(phrases)), about), hits).alias("_hits"))
    # what leaves a row: its marks once, and the words that have a valence
    # outer: a plain inline makes the optimizer filter by the hits' number first, working them out twice
    hit = rows.select(id_col, F.inline_outer("_hits")).where(F.col("word").isNotNull()).join(table, "word")
    v = F.col("valence") + F.when(F.col("valence") > 0, F.col("loud")).otherwise(-F.col("loud"))
    parts = rows.select(id_col, F.lit(0.0).alias("v"), "_marks").unionByName(
        hit.select(id_col, (_turned(v, F.col("steps")) * F.col("side")).alias("v"), F.lit(None).cast("double").alias("_marks")))
    total = parts.groupBy(id_col).agg(F.sum("v").alias("v"), F.max("_marks").alias("_marks"))
    s = F.col("v") + F.when(F.col("v") > 0, F.col("_marks")).when(F.col("v") < 0, -F.col("_marks")).otherwise(0.0)
    return total.select(id_col, s.alias("_s")).select(id_col, (F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + lexicon.ALPHA)).alias(
        "sentiment_score"))
