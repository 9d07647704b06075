"""Row filters, unions, de-duplication and derived columns (FLT, SET, DED, PRJ11)."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodspark.functions import text as T

# Literals a CSV reader of the reference's kind turns into missing values
# (fixed values: the default NA strings of that reader).
NA_STRINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]


def na_to_null(c) -> Column:
    """Map the reader's NA literals to null (CSV sources only)."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x.isin(NA_STRINGS), F.lit(None)).otherwise(x)


def drop_nulls(df: DataFrame, subset: list[str]) -> DataFrame:
    """FLT1."""
    return df.dropna(subset=subset)


def non_empty(df: DataFrame, col: str, strip: bool = True) -> DataFrame:
    """FLT2: ``len(x) > 0`` or, with ``strip``, ``x.strip() != ''``."""
    c = T.unicode_trim(F.col(col)) if strip else F.col(col)
    return df.where(F.length(c) > 0)


def min_tokens(df: DataFrame, col: str, n: int = 3, out: str | None = None) -> DataFrame:
    """FLT3 / FLT5: at least ``n`` white-space separated words, whose number is kept as ``out``."""
    if out is None:
        return df.where(T.token_count(F.col(col)) >= n)
    return df.select("*", T.once(T.token_count(F.col(col))).alias(out)).where(F.col(out) >= n)


def is_retweet(df: DataFrame, text_col: str, flag_col: str = "is_retweet") -> Column:
    """FLT4 predicate: flagged as retweet, or text starting with ``RT`` + space."""
    by_text = F.coalesce(F.col(text_col).rlike(T.LEADING_RT_WORD_RE), F.lit(False))
    if flag_col in df.columns:
        return F.coalesce(F.col(flag_col).cast("boolean"), F.lit(False)) | by_text
    return by_text


def drop_retweets(df: DataFrame, text_col: str, flag_col: str = "is_retweet") -> DataFrame:
    """FLT4."""
    return df.where(~is_retweet(df, text_col, flag_col))


def split_lines(df: DataFrame, col: str, out: str = "line", keep: list[str] | None = None) -> DataFrame:
    """FLT6: one record per non-blank line, stripped, with its 1-based ordinal."""
    keep = keep or []
    exploded = df.select(*keep, F.posexplode(F.split(F.col(col), "\n")).alias("pos", "raw"))
    stripped = T.unicode_trim(F.col("raw"))
    return (exploded.select(*keep, (F.col("pos") + 1).cast("long").alias("line_no"),
                            stripped.alias(out))
            .where(F.length(F.col(out)) > 0))


def split_valid(df: DataFrame, col: str = "text") -> tuple[DataFrame, DataFrame]:
    """FLT7: requests with text length >= 1 are valid; others rejected with a reason."""
    status = request_status(col)
    return df.where(status == "valid"), df.where(status != "valid").withColumn("reason", status)


def batch_status(df: DataFrame, batch_col: str, col: str = "text") -> DataFrame:
    """FLT7 for batches: how many items each has, and whether it is rejected: a
    batch needs an item at least, and each item must be valid.  Rows without an
    item (a null marker is no item) have ``col`` in ``df`` under ``is_item`` false."""
    bad = F.count_if(F.col("is_item") & (request_status(col) != "valid"))
    n = F.count_if("is_item")
    return df.groupBy(batch_col).agg(n.alias("n_items"), bad.alias("n_rejected")).withColumn(
        "status", F.when(F.col("n_items") < 1, F.lit("empty batch"))
        .when(F.col("n_rejected") > 0, F.lit("invalid item")).otherwise(F.lit("valid")))


def request_status(col: str = "text") -> Column:
    """FLT7 as a single column: ``valid`` or the rejection reason."""
    c = F.col(col)
    return (F.when(c.isNull(), F.lit("missing text"))
            .when(F.length(c) < 1, F.lit("text too short"))
            .otherwise(F.lit("valid")))


def union_sources(frames: list[tuple[str, DataFrame]], source_col: str = "source_dataset") -> DataFrame:
    """SET1 / SRC2: union by name, missing columns null, each tagged with its source.

    ``frames`` holds (name, DataFrame) pairs; ``None`` frames (missing inputs) are
    skipped.
    """
    tagged = [df.withColumn(source_col, F.lit(name)) for name, df in frames if df is not None]
    if not tagged:
        raise ValueError("no input source available")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def read_sources(spark, sources: list[tuple[str, str]], fmt: str = "parquet", **options):
    """SRC2: ``(name, path)`` pairs that exist, as ``(name, DataFrame)`` pairs for
    :func:`union_sources`, and the names of those that don't.  Only a missing
    path is skipped; any other error is the caller's."""
    found, missing = [], []
    for name, path in sources:
        try:
            found.append((name, spark.read.format(fmt).options(**options).load(path)))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            missing.append(name)
    return found, missing


def set_difference(words: DataFrame, remove: DataFrame, col: str = "word") -> DataFrame:
    """SET2 on tables: distinct words of ``words`` absent from ``remove``."""
    return words.select(col).distinct().join(remove.select(col), col, "left_anti")


def dedupe(df: DataFrame, key: str, order: list[str], id_col: str | None = None) -> DataFrame:
    """DED1: keep one row per ``key`` - the first by ``order``.

    Keys are grouped by their SHA-256 (equal texts, equal digests), so 32 bytes
    of a text cross the shuffle and not the text.

    A hot key (one text copied a billion times) is reduced map-side: the
    ``groupBy`` keeps only ``min(struct(order))`` per key in each task before the
    shuffle, so no task ever holds all copies.  The keepers are matched back
    with a semi-join on the unique ``id_col`` (default: the last order column),
    which is null-safe for the other order columns.
    """
    id_col = id_col or order[-1]
    keeper = F.min(F.struct(*[F.col(c) for c in order])).alias("_k")
    digest = F.unhex(F.sha2(F.col(key).cast("string"), 256))
    keepers = df.groupBy(digest.alias("_d")).agg(keeper).select(F.col(f"_k.{id_col}").alias(id_col))
    return df.join(keepers, id_col, "left_semi")


def derived_columns(df: DataFrame, tweet_col: str, source: str | Column, created_col: str | None = None) -> DataFrame:
    """PRJ11 + TXT13: tweet, tweet_clean, tweet_tokens, tweet_length, source, created_at.

    ``tweet_length`` is the number of characters of ``tweet_clean``.
    """
    src = F.lit(source) if isinstance(source, str) else source
    created = (F.try_to_timestamp(F.col(created_col).cast("string")) if created_col
               else F.lit(None).cast("timestamp"))
    # the cleaning chain runs once; what follows is derived from its result
    return df.select("*", T.clean_text(F.col(tweet_col)).alias("tweet_clean"), src.alias("source_dataset"),
                     created.alias("created_at")).select(
        *df.columns, "tweet_clean",
        T.join_tokens(T.tokens_of_clean("tweet_clean")).alias("tweet_tokens"),
        F.length("tweet_clean").cast("int").alias("tweet_length"), "source_dataset", "created_at")


def lemmatize(df: DataFrame, id_col: str, tokens_col: str, lemmas: DataFrame,
              out_col: str | None = None) -> DataFrame:
    """TXT12: ``(id, lemmatised tokens)``, each token replaced by its lemma
    from a ``(word, lemma)`` table.

    Tokens are expanded with their position, left-joined to the lemma table
    (broadcast if its size statistics allow it), and regrouped
    per document in position order.  Every document also contributes one null
    entry (skipped by ``collect_list``), so documents without tokens come out
    with an empty list and no join back to the input is needed: one shuffle,
    keyed by the unique id, each group bounded by one document's length.
    Unknown tokens are kept; a lemma may be shorter than the original token.
    """
    out_col = out_col or tokens_col
    t = F.col(tokens_col)
    ex = df.select(id_col, F.inline_outer(F.transform(t, lambda x, i: F.struct(i.alias("_p"), x.alias("_w"))))).where(
        F.col("_w").isNotNull())
    lem = lemmas.select(F.col("word").alias("_w"), F.col("lemma").alias("_l"))
    hits = ex.join(lem, "_w", "left").select(id_col, F.struct("_p", F.coalesce("_l", "_w").alias("_x")).alias("_e"))
    blanks = df.select(id_col, F.lit(None).cast("struct<_p:int,_x:string>").alias("_e"))
    g = hits.unionByName(blanks).groupBy(id_col).agg(F.array_sort(F.collect_list("_e")).alias("_s"))
    return g.select(id_col, F.transform("_s", lambda e: e["_x"]).alias(out_col))


# The published morphological rules for nouns, (ending, replacement) in order.
NOUN_RULES = [("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"),
              ("men", "man"), ("ies", "y")]
#: How often rules are applied to a word whose shorter forms are unknown.
RULE_ROUNDS = 3


def _rule_forms(forms: Column) -> Column:
    """What each rule makes of each form, in order."""
    def of(w: Column) -> Column:
        made = F.array(*[F.when(w.endswith(end), F.concat(F.left(w, F.length(w) - F.lit(len(end))), F.lit(new)))
                         for end, new in NOUN_RULES])
        return F.filter(made, lambda f: f.isNotNull())

    return F.flatten(F.transform(forms, of))


def noun_lemmas(tokens: DataFrame, tokens_col: str, words: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """TXT12: ``(word, lemma)`` of the words of a corpus that have another lemma.

    A word of the ``exceptions`` (``word, lemma``, several lemmas allowed) has itself and
    its lemmas as forms; any other word has itself and what the ending rules make of it,
    and what they make of that as long as no form is known.  The lemma is the shortest
    form that the word set ``words`` (``word``) holds, the first of equals.

    Work is by distinct words, not by occurrences: one aggregation of the vocabulary, and
    one lookup of all forms at once.
    """
    vocabulary = tokens.select(F.explode(F.array_distinct(tokens_col)).alias("word")).where("word <> ''").distinct()
    w = F.col("word")
    if exceptions is not None:
        listed = (exceptions.groupBy("word").agg(F.array_sort(F.collect_set("lemma")).alias("_own")))
        vocabulary = vocabulary.join(listed, "word", "left")
    else:
        vocabulary = vocabulary.withColumn("_own", F.lit(None).cast("array<string>"))
    rounds, last = [], F.array(w)
    for i in range(RULE_ROUNDS):
        last = _rule_forms(last)
        rounds.append(F.concat(F.array(w), last) if i == 0 else last)
    forms = F.when(F.col("_own").isNotNull(), F.array(F.concat(F.array(w), F.col("_own")))).otherwise(F.array(*rounds))
    tried = (vocabulary.select("word", F.posexplode(forms).alias("_round", "_forms"))
             .select("word", "_round", F.posexplode("_forms").alias("_place", "_form")).where("_form <> ''"))
    held = tried.join(words.select(F.col("word").alias("_form")).distinct(), "_form")
    best = held.groupBy("word").agg(F.min(F.struct("_round", F.length("_form").alias("_n"), "_place", "_form")).alias("_b"))
    return best.select("word", F.col("_b._form").alias("lemma")).where("word <> lemma")
