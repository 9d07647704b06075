"""Lexicon sentiment scoring and labelling (LAB1, LAB2).

The lexicon is a table ``(word, valence)`` supplied by the user.  Scoring is
relational: each token is expanded (``inline``) together with its three
predecessors, built row-locally with ``transform``, joined to the lexicon (broadcast where its statistics allow), adjusted for
boosters and negators, and summed per document.  Documents without a lexicon
hit contribute a zero row, so the per-document sum needs a single shuffle of
small partial aggregates and no join back to the text.

Rules (valence-aware lexicon scoring, Hutto & Gilbert 2014, simplified):
``v' = (v + sum_k sign(v) * b_k * d_k) * (-0.74) ** (#negators among the 3
previous tokens)`` where ``b_k`` is +0.293 / -0.293 for an intensifier /
dampener at distance k and ``d = (1, 0.95, 0.9)``; document score
``s / sqrt(s^2 + 15)``; label positive at >= 0.05, negative at <= -0.05.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# ---------------------------------------------------------------------------
# Fixed values (scoring constants of the published method)
# ---------------------------------------------------------------------------
NEGATION_SCALAR = -0.74
BOOST = 0.293
DECAY = [1.0, 0.95, 0.9]
ALPHA = 15.0
POSITIVE_AT = 0.05
NEGATIVE_AT = -0.05

# Context words written for this repository (lower case, letters only).
NEGATORS = ["not", "no", "never", "none", "nobody", "nothing", "neither", "nor",
            "nowhere", "without", "cannot", "nicht", "kein", "pas", "jamais"]
INTENSIFIERS = ["very", "really", "extremely", "absolutely", "totally", "completely",
                "most", "more", "so", "too", "sehr", "tres", "muy"]
DAMPENERS = ["barely", "hardly", "slightly", "somewhat", "less", "little", "partly"]

def lexicon_table(spark, entries: list[tuple[str, float]]) -> DataFrame:
    """A user's ``(word, valence)`` list as a table."""
    return spark.createDataFrame(entries, "word string, valence double")


def _in(c, words):
    return F.coalesce(c.isin(words), F.lit(False))


#: Words of a lexicon that go into the plan as a set; a longer one is met by the join alone.
MAX_WORDS = 50_000


def lexicon_score(df: DataFrame, id_col: str, tokens_col: str, lexicon: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """LAB1: (id, sentiment_score) for every row of ``df``."""
    t = F.col(tokens_col)
    # one struct per token with its three predecessors, built row-locally
    # (i is 0-based, so element_at(t, i) is the previous token) and expanded
    # with inline(): no per-token copy of the document's array
    ctx = F.transform(t, lambda x, i: F.struct(
        x.alias("tok"),
        F.when(i >= 1, F.element_at(t, i)).alias("p1"),
        F.when(i >= 2, F.element_at(t, i - 1)).alias("p2"),
        F.when(i >= 3, F.element_at(t, i - 2)).alias("p3")))
    lex = lexicon.select("word", "valence")
    # only words that the lexicon holds leave the row, if they are few enough for a set in the plan
    listed = [r[0] for r in lex.select("word").limit(max_words + 1).collect()]
    if len(listed) <= max_words:
        ctx = F.filter(ctx, lambda s: s["tok"].isin(listed) if listed else F.lit(False))
    ex = df.select(id_col, F.inline_outer(ctx)).where(F.col("tok").isNotNull())
    hits = ex.join(lex, ex["tok"] == lex["word"])
    v = F.col("valence")
    sign = F.when(v < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    boost = F.lit(0.0)
    neg = F.lit(0)
    for k, p in enumerate(["p1", "p2", "p3"]):
        pk = F.col(p)
        boost = boost + (F.when(_in(pk, INTENSIFIERS), BOOST).when(_in(pk, DAMPENERS), -BOOST)
                         .otherwise(0.0) * DECAY[k])
        neg = neg + F.when(_in(pk, NEGATORS), 1).otherwise(0)
    adj = (v + sign * boost) * F.pow(F.lit(NEGATION_SCALAR), neg)
    contrib = hits.select(id_col, adj.alias("v"))
    zeros = df.select(id_col, F.lit(0.0).alias("v"))
    s = zeros.unionByName(contrib).groupBy(id_col).agg(F.sum("v").alias("s"))
    score = F.col("s") / F.sqrt(F.col("s") * F.col("s") + ALPHA)
    return s.select(id_col, score.alias("sentiment_score"))


def score_label(score_col: str = "sentiment_score"):
    """LAB2."""
    s = F.col(score_col)
    return (F.when(s >= POSITIVE_AT, F.lit("positive"))
            .when(s <= NEGATIVE_AT, F.lit("negative"))
            .otherwise(F.lit("neutral")))
