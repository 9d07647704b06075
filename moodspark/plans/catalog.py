"""Query catalogue: one Spark job per inventory operator plus its SQL twin.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the driver tables (or data
Spark derives from them) and runs on whole tables and whole texts.  The twin
in :data:`ORACLE` is DuckDB SQL over the same tables; queries whose result is a
fitted model's output have no twin and are checked by properties in the tests.

Doubles are rounded to 6 decimals on both sides before comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodspark.functions import labels as L
from moodspark.functions import scores as SC
from moodspark.functions import text as T
from moodspark.functions.stopwords import english_stop_words
from moodspark.operators import ensemble, evaluate, features, lexicon, prep, sampling, stats, valence
from moodspark.plans import naive_bayes
from moodspark.plans import sql_twins as S
from moodspark.session import reliable_checkpoint, scratch_path
from moodspark.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: SQL text, or a function that makes it: what needs a package file is made
#: only when asked for, so that importing this module reads no file.
ORACLE: dict[str, str | Callable[[], str]] = {}


def query(name: str, sql: str | Callable[[], str] | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def oracle_sql() -> dict[str, str]:
    return {name: (sql() if callable(sql) else sql).strip() for name, sql in ORACLE.items()}


def r6(c):
    return F.round(c, 6)


# Shared derived views --------------------------------------------------------

def _tweets(spark, sf):
    return tables.decorated_tweets(spark, sf)


def _labelled_tokens(spark, sf):
    d = tables.labelled_documents(spark, sf)
    return d.select("doc_id", "source", "label", T.tokenize("text").alias("tokens"))


#: Smoothing of the primary and of the fallback naive Bayes model.
PRIMARY, FALLBACK = 0.1, 1.0
CLASSES = [0, 1, 2]


def _nb_corpus(spark, sf):
    """The labelled corpus split 70/15/15 (``doc_id, source, label, split``), the
    vocabulary of its train part and all documents' TF-IDF weights under it,
    each document's label and split beside them."""
    # tokens are ranked and kept; their n-grams, several times as long, are worked out where they are read
    t = reliable_checkpoint(_labelled_tokens(spark, sf))
    corpus = reliable_checkpoint(sampling.stratified_split(t, "label", "doc_id"))
    terms = features.ngrams("tokens", 2)
    vocab, _ = features.fit_vocabulary(corpus.where(F.col("split") == "train").select(terms.alias("terms")), "terms",
                                       NB["min_df"], NB["max_df"], NB["max_features"])
    vocab = reliable_checkpoint(vocab)  # read by each of the next steps
    weights = reliable_checkpoint(features.tfidf_long(corpus, "doc_id", terms, vocab, sublinear=True, carry=("label", "split"),
                                                      occurs=features.occurrences(vocab)))
    return corpus.select("doc_id", "source", "label", "split"), vocab, weights


def _nb_sums(corpus):
    """The sums of the train part's weights by class, over the vocabulary."""
    _, vocab, weights = corpus
    train = weights.where(F.col("split") == "train")
    return reliable_checkpoint(naive_bayes.over_vocabulary(naive_bayes.class_sums(train, CLASSES), vocab, CLASSES))


def _nb_scores(corpus, alphas: dict[str, float], sums=None):
    """Held-out documents with the joint log-probabilities of naive Bayes models
    fitted on the train part, one array for each smoothing value."""
    docs, _, weights = corpus
    sums = _nb_sums(corpus) if sums is None else sums
    total, v = naive_bayes.totals(sums, CLASSES)
    priors = naive_bayes.log_priors(docs.where(F.col("split") == "train"), CLASSES)
    return naive_bayes.joint_scores(docs.where(F.col("split") != "train"), weights.where(F.col("split") != "train"),
                                    sums, priors, total, v, alphas)


def _scores(spark, sf):
    """Held-out documents with per-class scores of two fitted models: ``s`` of the
    primary and ``f`` of the fallback."""
    return _nb_scores(_nb_corpus(spark, sf), {"s": PRIMARY, "f": FALLBACK}).drop("split")


def _predictions(spark, sf):
    return _scores(spark, sf).withColumn("prediction", SC.argmax("s"))


TOKS_SQL = f"toks AS (SELECT doc_id, source, label, {S.tokens('text')} AS tokens FROM labelled)"
NB = features.NOTEBOOK_CONFIG


def _nb_weights_sql() -> str:
    """CTEs: the split corpus, its train vocabulary, all documents' weights, and the
    sums of weights by class over the vocabulary with their totals and priors."""
    return f"""
{TOKS_SQL}, {S.class_rank_cte('toks', 'nb_ranked')},
nb_docs AS (SELECT doc_id, source, label, tokens, {S.SPLIT_EXPR} AS split FROM nb_ranked),
nb_u AS (SELECT doc_id, unnest(tokens) AS tok, unnest(generate_series(1, len(tokens))) AS i FROM nb_docs),
nb_f AS (SELECT doc_id, tok, i FROM nb_u WHERE length(tok) >= 2),
nb_b AS (SELECT doc_id, tok || ' ' || lead(tok) OVER (PARTITION BY doc_id ORDER BY i) AS term FROM nb_f),
nb_terms AS (SELECT doc_id, tok AS term FROM nb_f UNION ALL SELECT doc_id, term FROM nb_b WHERE term IS NOT NULL),
nb_n AS (SELECT count(*) AS n FROM nb_docs WHERE split = 'train'),
nb_st AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS ctf FROM nb_terms
          JOIN nb_docs USING (doc_id) WHERE split = 'train' GROUP BY term),
nb_vocab AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM nb_st, nb_n
             WHERE df >= {NB['min_df']} AND df <= {NB['max_df']} * n ORDER BY ctf DESC, term LIMIT {NB['max_features']}),
nb_tf AS (SELECT doc_id, term, (1 + ln(count(*))) * any_value(idf) AS w FROM nb_terms JOIN nb_vocab USING (term)
          GROUP BY doc_id, term),
nb_w AS (SELECT t.doc_id, d.label, d.split, t.term, t.w / sqrt(sum(t.w * t.w) OVER (PARTITION BY t.doc_id)) AS w
         FROM nb_tf t JOIN nb_docs d USING (doc_id))"""


def _nb_joint_sql(alphas: dict[str, float], name: str) -> str:
    """CTE ``name``: held-out documents with one score array for each smoothing value."""
    def joint(alpha: float) -> str:
        return "[" + ", ".join(
            f"any_value(p{c}) + coalesce(sum(w * ln((s{c} + {alpha}) / (t{c} + {alpha} * v))), 0.0)" for c in CLASSES) + "]"

    return f"""{_nb_weights_sql()},
nb_sums AS (SELECT v.term, {", ".join(f"coalesce(sum(w.w) FILTER (w.label = {c}), 0.0) AS s{c}" for c in CLASSES)}
            FROM nb_vocab v LEFT JOIN (SELECT * FROM nb_w WHERE split = 'train') w USING (term) GROUP BY v.term),
nb_tot AS (SELECT {", ".join(f"sum(s{c}) AS t{c}" for c in CLASSES)}, count(*) AS v FROM nb_sums),
nb_pri AS (SELECT {", ".join(f"ln(count(*) FILTER (label = {c}) / count(*)) AS p{c}" for c in CLASSES)}
           FROM nb_docs WHERE split = 'train'),
nb_hit AS (SELECT w.doc_id, w.w, s.* FROM nb_w w JOIN nb_sums s USING (term)),
{name} AS (SELECT d.doc_id, d.source, d.label, d.split, {", ".join(f"{joint(a)} AS {n}" for n, a in alphas.items())}
           FROM (SELECT * FROM nb_docs WHERE split <> 'train') d LEFT JOIN nb_hit h ON h.doc_id = d.doc_id, nb_tot, nb_pri
           GROUP BY d.doc_id, d.source, d.label, d.split)"""


SCORES_SQL = _nb_joint_sql({"s": PRIMARY, "f": FALLBACK}, "scores")
PRED_SQL = f"pred AS (SELECT doc_id, source, label, s, f, {S.argmax('s')} AS prediction FROM scores)"


def _lines(spark, sf):
    """Every non-blank line of every document, as a source of many short rows:
    ``key`` (order of document and line), ``doc_id, lang, line``."""
    d = tables.documents(spark, sf, "doc_id", "lang", "text")
    lines = prep.split_lines(d, "text", "line", keep=["doc_id", "lang"])
    return lines.select((F.col("doc_id") * 1_000_000 + F.col("line_no")).alias("key"), "doc_id", "lang", "line")


LINES_SQL = f"""
raw_lines AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS raw,
              unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no FROM documents),
lines AS (SELECT (doc_id * 1000000 + line_no)::BIGINT AS key, doc_id, lang, {S.unicode_trim('raw')} AS line FROM raw_lines
          WHERE length({S.unicode_trim('raw')}) > 0)"""


# ---------------------------------------------------------------------------
# Text functions (TXT)
# ---------------------------------------------------------------------------

@query("clean_text", f"""
WITH {S.TWEETS}
SELECT doc_id, {S.clean('tweet')} AS tweet_clean FROM tweets
""")
def q_clean_text(spark, sf):
    t = _tweets(spark, sf)
    return t.select("doc_id", T.clean_text("tweet").alias("tweet_clean"))


@query("tokenize_filter", f"""
WITH {S.TWEETS}
SELECT doc_id, {S.token_string('tweet')} AS tweet_tokens FROM tweets
""")
def q_tokenize_filter(spark, sf):
    t = _tweets(spark, sf)
    return t.select("doc_id", T.clean_and_tokenize("tweet").alias("tweet_tokens"))


@query("hashtag_mention_strip", f"""
WITH {S.TWEETS}
SELECT doc_id, regexp_replace(regexp_replace(tweet, {S.q(T.MENTION_RE)}, '', 'g'),
       {S.q(T.HASHTAG_RE)}, '\\1', 'g') AS stripped FROM tweets
""")
def q_hashtag_mention_strip(spark, sf):
    t = _tweets(spark, sf)
    return t.select("doc_id", T.unwrap_hashtags(T.strip_mentions("tweet")).alias("stripped"))


def _lexical_stop() -> list[str]:
    return list(english_stop_words())


@query("tokenize_lexical", lambda: f"""
WITH {S.TWEETS},
c AS (SELECT doc_id, {S.clean('tweet')} AS x FROM tweets),
k AS (SELECT doc_id,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x,
   '\\b(can)(not)\\b', '\\1 \\2', 'g'), '\\b(gim)(me)\\b', '\\1 \\2', 'g'), '\\b(gon)(na)\\b', '\\1 \\2', 'g'),
   '\\b(got)(ta)\\b', '\\1 \\2', 'g'), '\\b(lem)(me)\\b', '\\1 \\2', 'g'), '\\bwanna ', 'wan na ', 'g') AS x FROM c)
SELECT doc_id, array_to_string(list_filter(list_filter(string_split(x, ' '), lambda t: length(t) > 0),
  lambda t: NOT list_contains({S.sql_list(T.stop_word_list(_lexical_stop()))}, t) AND length(t) >= 3), ' ') AS tweet_tokens
FROM k
""")
def q_tokenize_lexical(spark, sf):
    """Lexical mode: the public English stop list minus the domain words, with
    word-tokenizer contraction splits."""
    t = _tweets(spark, sf)
    return t.select("doc_id", T.clean_and_tokenize("tweet", stop_words=_lexical_stop(),
                                                    lexical=True).alias("tweet_tokens"))


@query("stopword_difference", lambda: f"""
WITH {S.TWEETS},
stop AS (SELECT unnest({S.sql_list(_lexical_stop())}) AS word),
keep AS (SELECT unnest({S.sql_list(T.DOMAIN_WORDS)}) AS word),
diff AS (SELECT word FROM stop EXCEPT SELECT word FROM keep),
w AS (SELECT unnest(list_filter(string_split({S.clean('tweet')}, ' '), lambda t: length(t) > 0)) AS word FROM tweets)
SELECT word, count(*) AS n FROM w WHERE word IN (SELECT word FROM diff) GROUP BY word
""")
def q_stopword_difference(spark, sf):
    """SET2 on tables: (stop list minus domain words) occurring in the corpus."""
    stop = spark.createDataFrame([(w,) for w in _lexical_stop()], "word string")
    keep = spark.createDataFrame([(w,) for w in T.DOMAIN_WORDS], "word string")
    diff = prep.set_difference(stop, keep)
    words = _tweets(spark, sf).select(F.explode_outer(T.split_words(T.clean_text("tweet"))).alias("word")).where(
        F.col("word").isNotNull())
    counts = words.join(diff, "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    return counts


@query("word_top120", f"""
WITH {S.TWEETS},
w AS (SELECT unnest({S.tokens('tweet')}) AS word FROM tweets),
c AS (SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 120)
SELECT word, n, round(n / max(n) OVER (), 6) AS rel_freq FROM c
""")
def q_word_top120(spark, sf):
    t = _tweets(spark, sf)
    toks = t.select(T.tokenize("tweet").alias("tokens"))
    return stats.word_frequencies(toks, "tokens", 120).withColumn("rel_freq", r6(F.col("rel_freq")))


@query("word_top120_sketched", lambda: ORACLE["word_top120"])
def q_word_top120_sketched(spark, sf):
    """AGG6 by candidates of a sketch and an exact recount of those."""
    toks = _tweets(spark, sf).select(T.tokenize("tweet").alias("tokens"))
    return stats.word_frequencies(toks, "tokens", 120, tracked=stats.TRACKED).withColumn("rel_freq", r6(F.col("rel_freq")))


@query("input_order", "SELECT row_number() OVER () - 1 AS ordinal, conv_id, turn FROM conversations")
def q_input_order(spark, sf):
    """SCO4: every request numbered in the order of the input files."""
    from moodspark.operators.ordinals import number_input
    return number_input(tables.read_table(spark, sf, "conversations").select("conv_id", "turn", "_metadata")).select(
        "ordinal", "conv_id", "turn")


# ---------------------------------------------------------------------------
# Sources, projections, label maps (SRC, PRJ)
# ---------------------------------------------------------------------------

@query("resolve_columns", f"""
WITH {S.RAW}
SELECT content AS text, class AS label FROM raw WHERE content IS NOT NULL AND class IS NOT NULL
""")
def q_resolve_columns(spark, sf):
    from moodspark.sources.columns import resolve_text_label
    raw = tables.raw_labelled(spark, sf)
    return resolve_text_label(raw).dropna()


@query("project_rename", f"""
WITH {S.RAW}
SELECT content AS text, class AS label FROM raw
""")
def q_project_rename(spark, sf):
    from moodspark.sources.columns import resolve_text_label
    return resolve_text_label(tables.raw_labelled(spark, sf))


@query("resolve_columns_reporting", f"""
WITH {LINES_SQL},
c AS (SELECT key, {S.token_string('line')} AS tweet_tokens FROM lines)
SELECT key, tweet_tokens AS text FROM c WHERE tweet_tokens IS NOT NULL ORDER BY key LIMIT 1500
""")
def q_resolve_columns_reporting(spark, sf):
    """SRC5 over lines, of which there are more than the 1,500 that it keeps."""
    from moodspark.sources.columns import reporting_text
    c = prep.derived_columns(_lines(spark, sf), "line", F.col("lang"))
    return reporting_text(c, "key", ["tweet_tokens", "tweet_clean", "tweet"], 1500)


@query("label_normalise", f"""
WITH {S.RAW}
SELECT doc_id, class AS raw_label, {S.label_normalise('class')} AS label FROM raw WHERE class IS NOT NULL
""")
def q_label_normalise(spark, sf):
    raw = tables.raw_labelled(spark, sf).where(F.col("class").isNotNull())
    return raw.select("doc_id", F.col("class").alias("raw_label"),
                      L.normalise_label("class").alias("label"))


@query("label_map_strict", f"""
WITH {S.RAW}
SELECT doc_id, class AS raw_label,
  (CASE class WHEN 'positive' THEN 2 WHEN 'neutral' THEN 1 WHEN 'negative' THEN 0 END)::INTEGER AS label
FROM raw WHERE class IN ('positive', 'neutral', 'negative')
""")
def q_label_map_strict(spark, sf):
    raw = tables.raw_labelled(spark, sf)
    out = raw.select("doc_id", F.col("class").alias("raw_label"), L.strict_label("class").alias("label"))
    return out.dropna(subset=["label"])


@query("label_names", f"""
WITH {S.LABELLED}
SELECT doc_id, label, {S.label_name('label')} AS label_name FROM labelled
""")
def q_label_names(spark, sf):
    d = tables.labelled_documents(spark, sf)
    return d.select("doc_id", "label", L.label_name("label").alias("label_name"))


@query("expected_label", f"""
WITH {S.RAW}
SELECT doc_id, class AS raw_label, {S.expected_label('class')} AS expected FROM raw WHERE class IS NOT NULL
""")
def q_expected_label(spark, sf):
    raw = tables.raw_labelled(spark, sf).where(F.col("class").isNotNull())
    return raw.select("doc_id", F.col("class").alias("raw_label"), L.expected_label("class").alias("expected"))


@query("text_preview", f"""
WITH {S.TWEETS},
c AS (SELECT doc_id, tweet, {S.token_string('tweet')} AS tokens FROM tweets)
SELECT doc_id,
  CASE WHEN length(tweet) > 90 THEN substr(tweet, 1, 90) || '...' ELSE tweet END AS text_preview,
  substr(tokens, 1, 80) || '...' AS tokens_preview
FROM c
""")
def q_text_preview(spark, sf):
    t = _tweets(spark, sf)
    return t.select("doc_id", L.text_preview("tweet").alias("text_preview"),
                    L.tokens_preview(T.clean_and_tokenize("tweet")).alias("tokens_preview"))


def _round_exact_sql(x: str, places: int) -> str:
    """The exact-value rounding rule (see scores.round_exact), in SQL."""
    scale, split = float(10 ** places), 134217729.0
    ts = scale * split
    s_hi = ts - (ts - scale)
    s_lo = scale - s_hi
    hi = f"(({x}) * {split!r} - (({x}) * {split!r} - ({x})))"
    p = f"(({x}) * {scale!r})"
    err = f"((({hi} * {s_hi!r} - {p}) + {hi} * {s_lo!r} + (({x}) - {hi}) * {s_hi!r}) + (({x}) - {hi}) * {s_lo!r})"
    up = f"({p} - floor({p}) > 0.5 OR ({p} - floor({p}) = 0.5 AND ({err} > 0 OR ({err} = 0 AND floor({p})::BIGINT % 2 <> 0))))"
    return f"(CASE WHEN {up} THEN floor({p}) + 1 ELSE floor({p}) END / {scale!r})"


@query("round_scores", f"""
WITH {S.LABELLED}, {SCORES_SQL},
x AS (SELECT doc_id, CAST(s[1] AS DOUBLE) AS a, CAST(s[2] AS DOUBLE) AS b, CAST(doc_id AS DOUBLE) / 8 AS t FROM scores)
SELECT doc_id, {_round_exact_sql('round(a, 6)', 3)} AS s0_3dp, {_round_exact_sql('round(b, 6)', 4)} AS s1_4dp,
  {_round_exact_sql('t', 2)} AS t_2dp, {_round_exact_sql('t', 0)} AS t_0dp FROM x
""")
def q_round_scores(spark, sf):
    """PRJ7 on scores, and on eighths of the id, which hold exact ties."""
    s = _scores(spark, sf).withColumn("t", F.col("doc_id").cast("double") / 8)
    return s.select("doc_id", SC.round_exact(r6(F.col("s")[0]), 3).alias("s0_3dp"),
                    SC.round_exact(r6(F.col("s")[1]), 4).alias("s1_4dp"),
                    SC.round_exact("t", 2).alias("t_2dp"), SC.round_exact("t", 0).alias("t_0dp"))


@query("capitalise_label", f"""
WITH {S.LABELLED}
SELECT doc_id, upper(substr({S.label_name('label')}, 1, 1)) || lower(substr({S.label_name('label')}, 2)) AS label_cap
FROM labelled
""")
def q_capitalise_label(spark, sf):
    d = tables.labelled_documents(spark, sf)
    return d.select("doc_id", L.capitalise(L.label_name("label")).alias("label_cap"))


@query("correct_flag", f"""
WITH {S.LABELLED}, {SCORES_SQL}, {PRED_SQL}
SELECT doc_id, {S.label_name('label')} AS expected, {S.label_name('prediction')} AS predicted,
  CASE WHEN label = prediction THEN 'Oui' ELSE 'Non' END AS correct FROM pred
""")
def q_correct_flag(spark, sf):
    p = _predictions(spark, sf)
    e, q_ = L.label_name("label"), L.label_name("prediction")
    return p.select("doc_id", e.alias("expected"), q_.alias("predicted"),
                    L.correct_flag(e, q_).alias("correct"))


def _titles(spark, sf):
    """Demo-style titles ``<Positif|Negatif|Neutre> - <source> <doc_id>``."""
    p = _predictions(spark, sf)
    fr = F.element_at(F.array(F.lit("Negatif"), F.lit("Neutre"), F.lit("Positif")), F.col("label") + 1)
    title = F.concat(fr, F.lit(" - "), F.col("source"), F.lit(" "), F.col("doc_id").cast("string"))
    return p.select("doc_id", title.alias("title"), "prediction", "s")


TITLES_SQL = (f"titles AS (SELECT doc_id, ['Negatif', 'Neutre', 'Positif'][label + 1] || ' - ' || source || ' ' "
              f"|| CAST(doc_id AS VARCHAR) AS title, prediction, s FROM pred)")


@query("title_groups", f"""
WITH {S.LABELLED}, {SCORES_SQL}, {PRED_SQL}, {TITLES_SQL}
SELECT doc_id, split_part(title, ' - ', 1) AS grp, split_part(title, ' - ', 2) AS name,
  {S.expected_label("split_part(title, ' - ', 1)")} AS expected FROM titles
""")
def q_title_groups(spark, sf):
    t = _titles(spark, sf)
    return t.select("doc_id", L.title_group("title").alias("grp"), L.title_name("title").alias("name"),
                    L.expected_label(L.title_group("title")).alias("expected"))


@query("derived_columns", f"""
WITH {S.TWEETS}
SELECT doc_id, tweet, {S.clean('tweet')} AS tweet_clean, {S.token_string('tweet')} AS tweet_tokens,
  length({S.clean('tweet')})::INTEGER AS tweet_length, source AS source_dataset
FROM tweets
""")
def q_derived_columns(spark, sf):
    c = prep.derived_columns(_tweets(spark, sf), "tweet", F.col("source"))
    return c.select("doc_id", "tweet", "tweet_clean", "tweet_tokens", "tweet_length", "source_dataset")


@query("derived_created_at", """
WITH raw AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' WHEN o_orderkey % 5 = 0 THEN NULL
  ELSE strftime(o_orderdate::DATE, '%Y-%m-%d') || ' 08:30:' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') END AS said FROM orders)
SELECT id, strftime(try_cast(said AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS created_at FROM raw
""")
def q_derived_created_at(spark, sf):
    """PRJ11: ``created_at`` of records that bring a time along as text; what isn't one is null."""
    k = F.col("o_orderkey")
    said = F.when(k % 7 == 0, "unknown").when(k % 5 == 0, F.lit(None)).otherwise(F.concat(
        F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd"), F.lit(" 08:30:"), F.lpad((k % 60).cast("string"), 2, "0")))
    raw = tables.read_table(spark, sf, "orders").select(k.alias("id"), said.alias("said"), F.lit("").alias("tweet"))
    c = prep.derived_columns(raw, "tweet", "orders", "said")
    return c.select("id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


# ---------------------------------------------------------------------------
# Filters (FLT)
# ---------------------------------------------------------------------------

@query("drop_nulls", f"""
WITH {S.RAW}
SELECT doc_id, class FROM raw WHERE content IS NOT NULL AND class IS NOT NULL
""")
def q_drop_nulls(spark, sf):
    raw = tables.raw_labelled(spark, sf)
    return prep.drop_nulls(raw, ["content", "class"]).select("doc_id", "class")


@query("non_empty_text", f"""
WITH {S.TWEETS},
c AS (SELECT doc_id, {S.token_string('tweet')} AS tweet_tokens FROM tweets)
SELECT doc_id, tweet_tokens FROM c WHERE {S.unicode_trim('tweet_tokens')} <> ''
""")
def q_non_empty_text(spark, sf):
    c = _tweets(spark, sf).select("doc_id", T.clean_and_tokenize("tweet").alias("tweet_tokens"))
    return prep.non_empty(c, "tweet_tokens")


@query("min_tokens", f"""
WITH {S.TWEETS},
c AS (SELECT doc_id, {S.token_string('tweet')} AS tweet_tokens FROM tweets)
SELECT doc_id FROM c WHERE tweet_tokens IS NOT NULL AND {S.unicode_trim('tweet_tokens')} <> ''
  AND {S.token_count('tweet_tokens')} >= 3
""")
def q_min_tokens(spark, sf):
    c = _tweets(spark, sf).select("doc_id", T.clean_and_tokenize("tweet").alias("tweet_tokens"))
    c = prep.non_empty(prep.drop_nulls(c, ["tweet_tokens"]), "tweet_tokens")
    return prep.min_tokens(c, "tweet_tokens", 3).select("doc_id")


@query("short_text_filter", f"""
WITH {S.TWEETS},
c AS (SELECT doc_id, {S.clean('tweet')} AS tweet_clean FROM tweets)
SELECT doc_id, {S.token_count('tweet_clean')} AS n_words FROM c WHERE {S.token_count('tweet_clean')} >= 3
""")
def q_short_text_filter(spark, sf):
    c = _tweets(spark, sf).select("doc_id", T.clean_text("tweet").alias("tweet_clean"))
    return prep.min_tokens(c, "tweet_clean", 3, out="n_words").select("doc_id", "n_words")


@query("drop_retweets", f"""
WITH {S.TWEETS}
SELECT doc_id FROM tweets WHERE NOT coalesce(regexp_matches(tweet, {S.q(T.LEADING_RT_WORD_RE)}), false)
  AND NOT (doc_id % 11 = 0)
""")
def q_drop_retweets(spark, sf):
    """FLT4 with both rules: the text's prefix, and a flag column (here on every eleventh id)."""
    t = _tweets(spark, sf).withColumn("is_retweet", F.col("doc_id") % 11 == 0)
    return prep.drop_retweets(t, "tweet").select("doc_id")


@query("split_lines", f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
                  unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no FROM documents)
SELECT doc_id, line_no::BIGINT AS line_no, {S.unicode_trim('raw')} AS line FROM l
WHERE length({S.unicode_trim('raw')}) > 0
""")
def q_split_lines(spark, sf):
    d = tables.documents(spark, sf, "doc_id", "text")
    return prep.split_lines(d, "text", "line", keep=["doc_id"])


REQUESTS_SQL = """
req AS (SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 5 = 0 THEN NULL WHEN (conv_id + turn) % 7 = 0 THEN ''
        ELSE text END AS text FROM conversations)"""


def _raw_requests(spark, sf):
    """Conversation turns as requests, some without a text and some with an empty one."""
    k = F.col("conv_id") + F.col("turn")
    text = F.when(k % 5 == 0, F.lit(None)).when(k % 7 == 0, F.lit("")).otherwise(F.col("text"))
    return tables.conversation_turns(spark, sf).withColumn("text", text)


@query("reject_invalid", f"""
WITH {REQUESTS_SQL}
SELECT conv_id, turn, CASE WHEN text IS NULL THEN 'missing text' WHEN length(text) < 1 THEN 'text too short'
  ELSE 'valid' END AS status FROM req
""")
def q_reject_invalid(spark, sf):
    """FLT7: the valid requests, and the rejected ones with their reason."""
    valid, rejected = prep.split_valid(_raw_requests(spark, sf))
    return valid.select("conv_id", "turn", F.lit("valid").alias("status")).unionByName(
        rejected.select("conv_id", "turn", F.col("reason").alias("status")))


@query("reject_batches", f"""
WITH {REQUESTS_SQL},
b AS (SELECT conv_id, count(*) FILTER (WHERE turn % 3 = 1) AS n_items,
      count(*) FILTER (WHERE turn % 3 = 1 AND (text IS NULL OR length(text) < 1)) AS n_rejected FROM req GROUP BY conv_id)
SELECT conv_id, n_items, n_rejected, CASE WHEN n_items < 1 THEN 'empty batch' WHEN n_rejected > 0 THEN 'invalid item'
  ELSE 'valid' END AS status FROM b
""")
def q_reject_batches(spark, sf):
    """FLT7 for batches: a conversation's every third turn is a batch; some have none."""
    r = _raw_requests(spark, sf).withColumn("is_item", F.col("turn") % 3 == 1)
    return prep.batch_status(r, "conv_id")


# ---------------------------------------------------------------------------
# Sets, de-duplication, lexicon labels (SET, DED, LAB)
# ---------------------------------------------------------------------------

def _union(spark, sf):
    docs = tables.documents(spark, sf, "doc_id", "text")
    conv = tables.conversation_turns(spark, sf).select("conv_id", "turn", "role", "text")
    # SRC2: of the sources named, one doesn't exist and is skipped
    more, _ = prep.read_sources(spark, [(n, f"{sf}/{n}.parquet") for n in ("benchmark", "no_such_source")])
    return prep.union_sources([("documents", docs), ("conversations", conv), *more])


UNION_SQL = """u AS (
  SELECT doc_id, text, NULL::BIGINT AS conv_id, NULL::BIGINT AS turn, NULL::VARCHAR AS role,
         NULL::BIGINT AS item_id, 'documents' AS source_dataset FROM documents
  UNION ALL SELECT NULL, text, conv_id, turn, role, NULL, 'conversations' FROM conversations
  UNION ALL SELECT NULL, text, NULL, NULL, NULL, item_id, 'benchmark' FROM benchmark)"""


@query("union_sources", f"""
WITH {UNION_SQL}
SELECT doc_id, conv_id, turn, role, item_id, source_dataset, length(text)::INTEGER AS text_chars FROM u
""")
def q_union_sources(spark, sf):
    u = _union(spark, sf)
    return u.select("doc_id", "conv_id", "turn", "role", "item_id", "source_dataset",
                    F.length("text").alias("text_chars"))


@query("source_counts", f"""
WITH {UNION_SQL}
SELECT source_dataset, count(*) AS n FROM u GROUP BY source_dataset
""")
def q_source_counts(spark, sf):
    return _union(spark, sf).groupBy("source_dataset").agg(F.count("*").alias("n"))


@query("cap_rows_per_source", f"""
WITH {LINES_SQL}
SELECT key, lang FROM (SELECT key, lang, row_number() OVER (PARTITION BY lang ORDER BY key) AS r FROM lines) WHERE r <= 1500
""")
def q_cap_rows_per_source(spark, sf):
    """SRC3's cap on lines by language, some of which have more than 1,500."""
    from moodspark.sources.files import cap_rows_per_group
    return cap_rows_per_group(_lines(spark, sf).select("key", "lang"), "lang", "key", 1500)


@query("dedupe_text", """
SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS r
FROM documents) WHERE r = 1
""")
def q_dedupe_text(spark, sf):
    d = tables.documents(spark, sf, "doc_id", "source", "text")
    return prep.dedupe(d, "text", ["source", "doc_id"]).select("doc_id", "source")


# The lexicon that the registered queries bring along, as a user would: words that
# the test corpora hold, with valences made up for them (the library has none).
QUERY_LEXICON = [
    ("good", 1.9), ("great", 3.1), ("love", 3.2), ("peace", 2.5), ("hope", 1.9),
    ("bad", -2.5), ("hate", -2.7), ("war", -2.9), ("fear", -2.2), ("terrible", -2.1),
    ("the", 0.4), ("and", 0.3), ("that", -0.3), ("for", 0.6), ("was", -0.8),
    ("with", 1.1), ("this", -1.2), ("der", 0.7), ("die", -1.6), ("que", 0.9),
    ("les", -0.5), ("des", 0.2), ("und", 1.4), ("tion", -0.9),
]


def _lexicon_sql() -> str:
    vals = ", ".join(f"({S.q(w)}, {v!r})" for w, v in QUERY_LEXICON)
    neg = S.sql_list(lexicon.NEGATORS)
    up = S.sql_list(lexicon.INTENSIFIERS)
    down = S.sql_list(lexicon.DAMPENERS)

    def boost(p, k):
        return (f"(CASE WHEN list_contains({up}, {p}) THEN {lexicon.BOOST} WHEN list_contains({down}, {p}) "
                f"THEN -{lexicon.BOOST} ELSE 0.0 END) * {lexicon.DECAY[k]}")

    def isneg(p):
        return f"(CASE WHEN list_contains({neg}, {p}) THEN 1 ELSE 0 END)"

    return f"""
lex(word, valence) AS (VALUES {vals}),
w AS (SELECT doc_id, list_filter(string_split({S.clean('tweet')}, ' '), lambda t: length(t) > 0) AS words FROM tweets),
u AS (SELECT doc_id, unnest(words) AS tok, unnest(generate_series(1, len(words))) AS i FROM w),
ctx AS (SELECT doc_id, tok, lag(tok, 1) OVER d AS p1, lag(tok, 2) OVER d AS p2, lag(tok, 3) OVER d AS p3
        FROM u WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
hits AS (SELECT doc_id, (valence + (CASE WHEN valence < 0 THEN -1.0 ELSE 1.0 END) *
           ({boost('p1', 0)} + {boost('p2', 1)} + {boost('p3', 2)}))
           * pow({lexicon.NEGATION_SCALAR}, {isneg('p1')} + {isneg('p2')} + {isneg('p3')}) AS v
         FROM ctx JOIN lex ON ctx.tok = lex.word),
s AS (SELECT t.doc_id, coalesce(sum(h.v), 0.0) AS s FROM tweets t LEFT JOIN hits h ON t.doc_id = h.doc_id
      GROUP BY t.doc_id),
sc AS (SELECT doc_id, s / sqrt(s * s + {lexicon.ALPHA}) AS sentiment_score FROM s)"""


LEX_SQL = _lexicon_sql()


def _lexicon_scores(spark, sf):
    t = _tweets(spark, sf).select("doc_id", T.split_words(T.clean_text("tweet")).alias("words"))
    return lexicon.lexicon_score(t, "doc_id", "words", lexicon.lexicon_table(spark, QUERY_LEXICON))


@query("lexicon_score", f"""
WITH {S.TWEETS}, {LEX_SQL}
SELECT doc_id, round(sentiment_score, 6) AS sentiment_score FROM sc
""")
def q_lexicon_score(spark, sf):
    s = _lexicon_scores(spark, sf)
    return s.select("doc_id", r6(F.col("sentiment_score")).alias("sentiment_score"))


@query("lexicon_label", f"""
WITH {S.TWEETS}, {LEX_SQL}
SELECT CASE WHEN sentiment_score >= 0.05 THEN 'positive' WHEN sentiment_score <= -0.05 THEN 'negative'
  ELSE 'neutral' END AS sentiment_label, count(*) AS n FROM sc GROUP BY 1
""")
def q_lexicon_label(spark, sf):
    s = _lexicon_scores(spark, sf)
    return s.groupBy(lexicon.score_label().alias("sentiment_label")).agg(F.count("*").alias("n"))


# Idioms that the registered queries bring along, in words that the corpora hold.
QUERY_IDIOMS = [("with this", 1.7), ("for that", -1.3), ("for that the", 0.9), ("this was", 2.1), ("und der", -0.6)]


def _valence_sql() -> str:
    """All valence rules, a word a row with the three before it."""
    c = valence.Context()
    lex = ", ".join(f"({S.q(w)}, {v!r})" for w, v in QUERY_LEXICON + [(w.replace(" ", valence.JOIN), v) for w, v in QUERY_IDIOMS])
    known = S.sql_list([w for w, _ in QUERY_LEXICON] + [w.replace(" ", valence.JOIN) for w, _ in QUERY_IDIOMS])
    boosts = ", ".join(f"({S.q(w)}, {b!r})" for w, b in c.boosters.items())
    neg, never, stress = (S.sql_list(list(x)) for x in (c.negators, c.never, c.stress))
    pattern, space = S.q("(?i)" + valence.idiom_pattern([w for w, _ in QUERY_IDIOMS])), S.q(f"{valence.SPACE}+")
    steps, last = [], "v0"
    for k in (1, 2, 3):
        near = {1: "FALSE", 2: f"list_contains({stress}, lower(p1))", 3: f"(list_contains({stress}, lower(p1)) OR list_contains({stress}, lower(p2)))"}[k]
        turn = f"CASE WHEN list_contains({neg}, lower(p{k})) THEN {lexicon.NEGATION_SCALAR} ELSE 1.0 END"
        if k > 1:
            turn = (f"CASE WHEN list_contains({never}, lower(p{k})) AND {near} THEN {valence.NEVER_NEAR if k == 2 else valence.NEVER_FAR} "
                    f"ELSE {turn} END")
        steps.append(f"""
v{k} AS (SELECT *, CASE WHEN p{k} IS NULL OR list_contains({known}, lower(p{k})) THEN x{k - 1} ELSE
  (x{k - 1} + CASE WHEN x{k - 1} < 0 THEN -1 ELSE 1 END * coalesce(b{k}, 0.0) * {lexicon.DECAY[k - 1]}
   + CASE WHEN b{k} IS NOT NULL AND shouted AND upper(p{k}) = p{k} AND lower(p{k}) <> p{k}
       THEN CASE WHEN x{k - 1} > 0 THEN {valence.CAPITALS} ELSE -{valence.CAPITALS} END * {lexicon.DECAY[k - 1]} ELSE 0 END) * {turn} END AS x{k} FROM {last})""")
        last = f"v{k}"
    return f"""
vlex(word, valence) AS (VALUES {lex}), boost(word, b) AS (VALUES {boosts}),
cut AS (SELECT doc_id, tweet, string_split_regex(tweet, {pattern}) AS parts, regexp_extract_all(tweet, {pattern}) AS found FROM tweets),
vw AS (SELECT doc_id, tweet, flatten(list_transform(range(1, len(parts) + 1), lambda j: list_concat(
   list_transform(list_filter(string_split_regex(parts[j], {space}), lambda x: x <> ''), lambda x:
     CASE WHEN length(trim(x, {S.q(valence.PUNCTUATION)})) > 2 THEN trim(x, {S.q(valence.PUNCTUATION)}) ELSE x END),
   CASE WHEN j <= len(found) THEN [regexp_replace(found[j], {space}, {S.q(valence.JOIN)}, 'g')] ELSE [] END))) AS w FROM cut),
vs AS (SELECT doc_id, w, len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x)) AS loud,
   list_position(list_transform(w, lambda x: lower(x)), 'but') AS but FROM vw),
vu AS (SELECT doc_id, loud > 0 AND loud < len(w) AS shouted, but, unnest(w) AS x, unnest(generate_series(1, len(w))) AS i FROM vs),
vc AS (SELECT *, lag(x, 1) OVER d AS p1, lag(x, 2) OVER d AS p2, lag(x, 3) OVER d AS p3 FROM vu WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
v0 AS (SELECT vc.*, b1.b AS b1, b2.b AS b2, b3.b AS b3, valence + CASE WHEN shouted AND upper(x) = x AND lower(x) <> x
     THEN CASE WHEN valence > 0 THEN {valence.CAPITALS} ELSE -{valence.CAPITALS} END ELSE 0 END AS x0
  FROM vc JOIN vlex ON lower(x) = vlex.word LEFT JOIN boost b1 ON lower(p1) = b1.word LEFT JOIN boost b2 ON lower(p2) = b2.word
  LEFT JOIN boost b3 ON lower(p3) = b3.word WHERE lower(x) NOT IN (SELECT word FROM boost)),{','.join(steps)},
vsum AS (SELECT doc_id, sum(x3 * CASE WHEN coalesce(but, 0) = 0 OR i = but THEN 1.0 WHEN i < but THEN {valence.BEFORE_BUT} ELSE {valence.AFTER_BUT} END) AS v
  FROM v3 GROUP BY doc_id),
vmark AS (SELECT doc_id, least(len(regexp_extract_all(tweet, '!')), {valence.MOST_EXCLAMATIONS}) * {valence.EXCLAMATION}
  + CASE WHEN len(regexp_extract_all(tweet, '\\?')) <= 1 THEN 0 WHEN len(regexp_extract_all(tweet, '\\?')) <= {valence.MOST_QUESTIONS}
    THEN len(regexp_extract_all(tweet, '\\?')) * {valence.QUESTION} ELSE {valence.MANY_QUESTIONS} END AS marks FROM tweets),
vt AS (SELECT m.doc_id, coalesce(v, 0) + CASE WHEN v > 0 THEN marks WHEN v < 0 THEN -marks ELSE 0 END AS s FROM vmark m LEFT JOIN vsum USING (doc_id)),
vscore AS (SELECT doc_id, s / sqrt(s * s + {lexicon.ALPHA}) AS sentiment_score FROM vt)"""


VALENCE_SQL = _valence_sql()


def _valence_scores(spark, sf):
    idioms = spark.createDataFrame(QUERY_IDIOMS, "idiom string, valence double")
    return valence.valence_score(_tweets(spark, sf), "doc_id", "tweet", lexicon.lexicon_table(spark, QUERY_LEXICON), idioms)


@query("valence_score", f"""
WITH {S.TWEETS}, {VALENCE_SQL}
SELECT doc_id, round(sentiment_score, 6) AS sentiment_score FROM vscore
""")
def q_valence_score(spark, sf):
    """LAB1 with all valence rules on raw tweets: case, boosters, negations, "but", idioms, marks."""
    return _valence_scores(spark, sf).select("doc_id", r6(F.col("sentiment_score")).alias("sentiment_score"))


@query("valence_label", f"""
WITH {S.TWEETS}, {VALENCE_SQL}
SELECT CASE WHEN sentiment_score >= 0.05 THEN 'positive' WHEN sentiment_score <= -0.05 THEN 'negative'
  ELSE 'neutral' END AS sentiment_label, count(*) AS n FROM vscore GROUP BY 1
""")
def q_valence_label(spark, sf):
    return _valence_scores(spark, sf).groupBy(lexicon.score_label().alias("sentiment_label")).agg(F.count("*").alias("n"))


# ---------------------------------------------------------------------------
# Features (FEA)
# ---------------------------------------------------------------------------

def _terms_sql(src: str = "toks", where: str = "TRUE") -> str:
    """Long-form 1- and 2-grams of the filtered tokens of ``src``."""
    return f"""
u AS (SELECT doc_id, unnest(tokens) AS tok, unnest(generate_series(1, len(tokens))) AS i FROM {src} WHERE {where}),
f AS (SELECT doc_id, tok, i FROM u WHERE length(tok) >= 2),
bi AS (SELECT doc_id, tok || ' ' || lead(tok) OVER (PARTITION BY doc_id ORDER BY i) AS term FROM f),
terms AS (SELECT doc_id, tok AS term FROM f UNION ALL SELECT doc_id, term FROM bi WHERE term IS NOT NULL)"""


def _vocab_sql(min_df, max_df, max_features, ndocs_from: str = "toks", where: str = "TRUE") -> str:
    lo = f"{min_df} * n.n" if isinstance(min_df, float) else str(min_df)
    hi = f"{max_df} * n.n" if isinstance(max_df, float) else str(max_df)
    return f"""
n AS (SELECT count(*) AS n FROM {ndocs_from} WHERE {where}),
st AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS ctf FROM terms GROUP BY term),
vocab AS (SELECT term, df, ctf, ln((1 + n.n) / (1 + df)) + 1 AS idf FROM st, n
          WHERE df >= {lo} AND df <= {hi} ORDER BY ctf DESC, term LIMIT {max_features})"""


def _tfidf_sql(sublinear: bool, terms: str = "terms") -> str:
    tfw = "(1 + ln(tf))" if sublinear else "tf"
    return f"""
tf AS (SELECT doc_id, term, count(*) AS tf FROM {terms} JOIN vocab USING (term) GROUP BY doc_id, term),
w AS (SELECT doc_id, term, {tfw} * idf AS w FROM tf JOIN vocab USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w"""


def _terms(spark, sf):
    t = _labelled_tokens(spark, sf)
    return t.select("doc_id", "label", features.ngrams("tokens", 2).alias("terms"))


@query("ngrams", f"""
WITH {S.LABELLED}, {TOKS_SQL}, {_terms_sql()}
SELECT doc_id, term, count(*) AS n FROM terms GROUP BY doc_id, term
""")
def q_ngrams(spark, sf):
    t = _terms(spark, sf)
    return (t.select("doc_id", F.explode_outer("terms").alias("term")).where(F.col("term").isNotNull())
            .groupBy("doc_id", "term").agg(F.count("*").alias("n")))


CLI = features.CLI_CONFIG


@query("vocabulary_topk", f"""
WITH {S.LABELLED}, {TOKS_SQL}, {_terms_sql()}, {_vocab_sql(NB['min_df'], NB['max_df'], NB['max_features'])}
SELECT term, df, ctf, round(idf, 6) AS idf, (row_number() OVER (ORDER BY term) - 1)::INTEGER AS idx FROM vocab
""")
def q_vocabulary_topk(spark, sf):
    v, _ = features.fit_vocabulary(_terms(spark, sf), "terms", NB["min_df"], NB["max_df"], NB["max_features"])
    return v.select("term", "df", "ctf", r6(F.col("idf")).alias("idf"), "idx")


@query("tfidf_sublinear", f"""
WITH {S.LABELLED}, {TOKS_SQL}, {_terms_sql()}, {_vocab_sql(NB['min_df'], NB['max_df'], NB['max_features'])},
{_tfidf_sql(True)}
""")
def q_tfidf_sublinear(spark, sf):
    t, terms = reliable_checkpoint(_labelled_tokens(spark, sf).select("doc_id", "tokens")), features.ngrams("tokens", 2)
    v, _ = features.fit_vocabulary(t.select(terms.alias("terms")), "terms", NB["min_df"], NB["max_df"], NB["max_features"])
    w = features.tfidf_long(t, "doc_id", terms, v, sublinear=True, occurs=features.occurrences(v))
    return w.select("doc_id", "term", r6(F.col("weight")).alias("weight"))


@query("tfidf_plain", f"""
WITH {S.LABELLED}, {TOKS_SQL}, {_terms_sql()}, {_vocab_sql(CLI['min_df'], CLI['max_df'], CLI['max_features'])},
{_tfidf_sql(False)}
""")
def q_tfidf_plain(spark, sf):
    t = reliable_checkpoint(_terms(spark, sf))
    v, _ = features.fit_vocabulary(t, "terms", CLI["min_df"], CLI["max_df"], CLI["max_features"])
    w = features.tfidf_long(t, "doc_id", "terms", v, sublinear=False)
    return w.select("doc_id", "term", r6(F.col("weight")).alias("weight"))


SPLIT_SQL = (f"{S.class_rank_cte('toks', 'ranked')}, "
             f"split AS (SELECT doc_id, label, tokens, {S.SPLIT_EXPR} AS split FROM ranked)")


@query("frozen_vocab_transform", f"""
WITH {S.LABELLED}, {TOKS_SQL}, {SPLIT_SQL}, {_terms_sql('split')},
train_terms AS (SELECT * FROM terms WHERE doc_id IN (SELECT doc_id FROM split WHERE split = 'train')),
{_vocab_sql(NB['min_df'], NB['max_df'], NB['max_features'], 'split', "split = 'train'").replace('FROM terms GROUP', 'FROM train_terms GROUP')},
held AS (SELECT * FROM terms WHERE doc_id IN (SELECT doc_id FROM split WHERE split <> 'train')),
{_tfidf_sql(True, 'held')}
""")
def q_frozen_vocab_transform(spark, sf):
    t, terms = reliable_checkpoint(_labelled_tokens(spark, sf).drop("source")), features.ngrams("tokens", 2)
    s = reliable_checkpoint(sampling.stratified_split(t, "label", "doc_id"))
    train = s.where(F.col("split") == "train").select(terms.alias("terms"))
    v, _ = features.fit_vocabulary(train, "terms", NB["min_df"], NB["max_df"], NB["max_features"])
    held = s.where(F.col("split") != "train")
    w = features.tfidf_long(held, "doc_id", terms, v, sublinear=True, occurs=features.occurrences(v))
    return w.select("doc_id", "term", r6(F.col("weight")).alias("weight"))


# ---------------------------------------------------------------------------
# Sampling (SMP) and class weights (MOD6)
# ---------------------------------------------------------------------------

CAP_PER_CLASS = 100


@query("stratified_cap", f"""
WITH {S.LABELLED}, {S.class_rank_cte('labelled')}
SELECT doc_id, label FROM ranked WHERE rnk <= {CAP_PER_CLASS}
""")
def q_stratified_cap(spark, sf):
    d = tables.labelled_documents(spark, sf).select("doc_id", "label")
    return sampling.stratified_cap(d, "label", "doc_id", CAP_PER_CLASS)


@query("stratified_split", f"""
WITH {S.LABELLED}, {S.class_rank_cte('labelled')}
SELECT doc_id, label, {S.SPLIT_EXPR} AS split FROM ranked
""")
def q_stratified_split(spark, sf):
    d = tables.labelled_documents(spark, sf).select("doc_id", "label")
    return sampling.stratified_split(d, "label", "doc_id")


@query("stratified_folds", f"""
WITH {S.LABELLED}, {S.class_rank_cte('labelled')}
SELECT doc_id, label, ((rnk - 1) % 5)::INTEGER AS fold FROM ranked
""")
def q_stratified_folds(spark, sf):
    d = tables.labelled_documents(spark, sf).select("doc_id", "label")
    return sampling.stratified_folds(d, "label", "doc_id", 5)


@query("shuffle_order", """
SELECT doc_id, md5('42|' || CAST(doc_id AS VARCHAR)) AS shuffle_key FROM labels
""")
def q_shuffle_order(spark, sf):
    d = tables.read_table(spark, sf, "labels").select("doc_id")
    return sampling.shuffled(d, "doc_id").withColumn("shuffle_key", sampling.hash_key("doc_id"))


@query("class_weights", f"""
WITH {S.LABELLED},
c AS (SELECT label, count(*) AS n_c FROM labelled GROUP BY label),
k AS (SELECT count(*) AS k, sum(n_c) AS n FROM c)
SELECT l.doc_id, l.label, round(k.n / (k.k * c.n_c), 6) AS weight FROM labelled l JOIN c USING (label), k
""")
def q_class_weights(spark, sf):
    from moodspark.plans.training import balanced_weights
    d = tables.labelled_documents(spark, sf).select("doc_id", "label")
    return balanced_weights(d, "label").select("doc_id", "label", r6(F.col("weight")).alias("weight"))


@query("nb_closed_form", f"""
WITH {S.LABELLED}, {TOKS_SQL}, {_terms_sql()}, {_vocab_sql(NB['min_df'], NB['max_df'], NB['max_features'])},
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms JOIN vocab USING (term) GROUP BY doc_id, term),
w0 AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN vocab USING (term)),
w AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM w0),
cw AS (SELECT t.label, w.term, sum(w.w) AS s FROM w JOIN toks t USING (doc_id) GROUP BY t.label, w.term),
cls AS (SELECT DISTINCT label FROM toks),
grid AS (SELECT cls.label, vocab.term FROM cls, vocab),
full_ AS (SELECT g.label, g.term, coalesce(cw.s, 0.0) AS s FROM grid g LEFT JOIN cw USING (label, term)),
tot AS (SELECT label, sum(s) AS total FROM full_ GROUP BY label),
v AS (SELECT count(*) AS v FROM vocab)
SELECT f.label, f.term, round(ln((f.s + 0.1) / (tot.total + 0.1 * v.v)), 6) AS log_theta
FROM full_ f JOIN tot USING (label), v
""")
def q_nb_closed_form(spark, sf):
    from moodspark.plans.training import naive_bayes_long
    t, terms = reliable_checkpoint(_labelled_tokens(spark, sf).drop("source")), features.ngrams("tokens", 2)
    v, _ = features.fit_vocabulary(t.select(terms.alias("terms")), "terms", NB["min_df"], NB["max_df"], NB["max_features"])
    v = reliable_checkpoint(v)  # read by each of the next steps
    w = reliable_checkpoint(features.tfidf_long(t, "doc_id", terms, v, sublinear=True, carry=("label",),
                                                occurs=features.occurrences(v)))
    theta = naive_bayes_long(w, v, "label", smoothing=0.1)
    return theta.select("label", "term", r6(F.col("log_theta")).alias("log_theta"))


# ---------------------------------------------------------------------------
# Ensembles and routing on score tables (MOD7, MOD8, MOD10, MOD11)
# ---------------------------------------------------------------------------

@query("weighted_ensemble", f"""
WITH {S.LABELLED}, {SCORES_SQL},
c AS (SELECT doc_id, [s[1] * 0.65 + f[1] * 0.35, s[2] * 0.65 + f[2] * 0.35, s[3] * 0.65 + f[3] * 0.35] AS c FROM scores)
SELECT doc_id, round(c[1], 6) AS c0, round(c[2], 6) AS c1, round(c[3], 6) AS c2, {S.argmax('c')} AS prediction FROM c
""")
def q_weighted_ensemble(spark, sf):
    e = ensemble.weighted_ensemble(_scores(spark, sf), ["s", "f"], [0.65, 0.35])
    return e.select("doc_id", *[r6(F.col("scores")[i]).alias(f"c{i}") for i in range(3)], "prediction")


ROUTE_SQL = f"""rt AS (SELECT doc_id, list_sort(s, 'DESC')[1] - list_sort(s, 'DESC')[2] AS margin, s, f FROM scores),
routed AS (SELECT doc_id, margin, margin < 0.35 AS use_fallback,
  CASE WHEN margin < 0.35 THEN {S.argmax('f')} ELSE {S.argmax('s')} END AS prediction FROM rt)"""


@query("confidence_route", f"""
WITH {S.LABELLED}, {SCORES_SQL}, {ROUTE_SQL}
SELECT doc_id, round(margin, 6) AS margin, use_fallback, prediction FROM routed
""")
def q_confidence_route(spark, sf):
    r = ensemble.confidence_route(_scores(spark, sf), "s", "f", 0.35)
    return r.select("doc_id", r6(F.col("margin")).alias("margin"), "use_fallback", "prediction")


@query("fallback_rate", f"""
WITH {S.LABELLED}, {SCORES_SQL}, {ROUTE_SQL}
SELECT round(avg(CASE WHEN use_fallback THEN 1.0 ELSE 0.0 END), 6) AS fallback_rate, count(*) AS n FROM routed
""")
def q_fallback_rate(spark, sf):
    r = ensemble.confidence_route(_scores(spark, sf), "s", "f", 0.35)
    return ensemble.fallback_rate(r).select(r6(F.col("fallback_rate")).alias("fallback_rate"), "n")


def _report_sql(src: str, group: str | None = None) -> str:
    """Per-class precision/recall/F1/support from a (label, prediction) table."""
    g = f"{group}, " if group else ""
    gb = f"GROUP BY {group}, cls" if group else "GROUP BY cls"
    return f"""
cm AS (SELECT {g}label, prediction, count(*) AS n FROM {src} GROUP BY {g}label, prediction),
e AS (SELECT {g}label AS cls, n AS support, 0 AS predicted, CASE WHEN label = prediction THEN n ELSE 0 END AS tp FROM cm
      UNION ALL SELECT {g}prediction, 0, n, 0 FROM cm),
per AS (SELECT {g}cls, sum(support) AS support, sum(predicted) AS predicted, sum(tp) AS tp FROM e {gb}),
pr AS (SELECT {g}cls, support, coalesce(tp / nullif(predicted, 0), 0.0) AS precision,
       coalesce(tp / nullif(support, 0), 0.0) AS recall FROM per),
rep AS (SELECT {g}cls, support, precision, recall,
        coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM pr)"""


@query("cv_summary", f"""
WITH {S.LABELLED}, {_nb_weights_sql()},
cv_ranked AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY
              md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) AS rnk FROM nb_docs WHERE split = 'train'),
cv AS (SELECT doc_id, label, ((rnk - 1) % 5)::INTEGER AS fold FROM cv_ranked),
cvw AS (SELECT w.doc_id, cv.fold, cv.label, w.term, w.w FROM nb_w w JOIN cv USING (doc_id)),
folds AS (SELECT DISTINCT fold FROM cv),
part AS (SELECT f.fold, v.term, {", ".join(f"coalesce(sum(c.w) FILTER (c.label = {k} AND c.fold <> f.fold), 0.0) AS s{k}" for k in CLASSES)}
         FROM folds f CROSS JOIN nb_vocab v LEFT JOIN cvw c ON c.term = v.term GROUP BY f.fold, v.term),
tot AS (SELECT fold, {", ".join(f"sum(s{k}) AS t{k}" for k in CLASSES)}, count(*) AS v FROM part GROUP BY fold),
pri AS (SELECT f.fold, {", ".join(f"ln(count(*) FILTER (cv.label = {k}) / count(*)) AS p{k}" for k in CLASSES)}
        FROM folds f JOIN cv ON cv.fold <> f.fold GROUP BY f.fold),
joint AS (SELECT cv.doc_id, cv.fold, cv.label, [{", ".join(
    f"any_value(p{k}) + coalesce(sum(c.w * ln((s{k} + {PRIMARY}) / (t{k} + {PRIMARY} * v))), 0.0)" for k in CLASSES)}] AS s
  FROM cv JOIN tot USING (fold) JOIN pri USING (fold) LEFT JOIN cvw c ON c.doc_id = cv.doc_id
  LEFT JOIN part p ON p.fold = cv.fold AND p.term = c.term GROUP BY cv.doc_id, cv.fold, cv.label),
fp AS (SELECT fold, label, {S.argmax('s')} AS prediction FROM joint),
{_report_sql('fp', 'fold')},
ff AS (SELECT fold, sum(f1 * support) / sum(support) AS f1w FROM rep GROUP BY fold)
SELECT round(avg(f1w), 6) AS cv_f1_mean, round(stddev_pop(f1w), 6) AS cv_f1_std, count(*) AS folds FROM ff
""")
def q_cv_summary(spark, sf):
    """MOD10: five folds of the train part under its vocabulary; each fold is
    predicted by naive Bayes fitted on the other four."""
    return _cv_summary(_nb_corpus(spark, sf), PRIMARY)


def _cv_summary(corpus, alpha):
    from moodspark.plans.training import per_group_summary
    docs, vocab, weights = corpus
    folds = reliable_checkpoint(sampling.stratified_folds(docs.where(F.col("split") == "train").select("doc_id", "label"),
                                                          "label", "doc_id", 5))
    w = weights.drop("label").join(folds, "doc_id")
    scored = naive_bayes.fold_scores(folds, w, vocab, CLASSES, alpha).withColumn("prediction", SC.argmax("scores"))
    f = per_group_summary(scored, "fold")
    return f.agg(r6(F.avg("f1_weighted")).alias("cv_f1_mean"), r6(F.stddev_pop("f1_weighted")).alias("cv_f1_std"),
                 F.count("*").alias("folds"))


#: Models of the comparison: naive Bayes by its smoothing, in the order of the runs.
MODEL_ALPHAS = {"nb_0_01": 0.01, "nb_0_1": 0.1, "nb_1": 1.0, "nb_10": 10.0}


def _model_predictions(corpus, sums=None):
    """Predictions of the four models on the held-out documents."""
    s = _nb_scores(corpus, MODEL_ALPHAS, sums)
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i).alias("run_order"), SC.argmax(m).alias("prediction"))
                     for i, m in enumerate(MODEL_ALPHAS)])
    return s.select("doc_id", "label", "split", F.inline(each))


COMPARISON_SQL = f"""{_nb_joint_sql(MODEL_ALPHAS, 'scores')},
mps AS ({" UNION ALL ".join(
    f"SELECT '{m}|' || split AS grp, label, {S.argmax(m)} AS prediction FROM scores" for m in MODEL_ALPHAS)}),
{_report_sql('mps', 'grp')},
g AS (SELECT grp, sum(f1 * support) / sum(support) AS f1w, sum(recall * support) / sum(support) AS acc FROM rep GROUP BY grp),
cmp AS (SELECT split_part(grp, '|', 1) AS model,
  max(CASE WHEN split_part(grp, '|', 2) = 'val' THEN acc END) AS accuracy_val,
  max(CASE WHEN split_part(grp, '|', 2) = 'val' THEN f1w END) AS f1_val,
  max(CASE WHEN split_part(grp, '|', 2) = 'test' THEN acc END) AS accuracy_test,
  max(CASE WHEN split_part(grp, '|', 2) = 'test' THEN f1w END) AS f1_test
  FROM g GROUP BY 1)"""


def _comparison(spark, sf):
    from moodspark.plans.training import comparison_from_predictions
    return comparison_from_predictions(_model_predictions(_nb_corpus(spark, sf)))


@query("best_model", f"""
WITH {S.LABELLED}, {COMPARISON_SQL},
ro AS (SELECT model, f1_test, list_position({S.sql_list(list(MODEL_ALPHAS))}, model) AS run_order FROM cmp)
SELECT model, round(f1_test, 6) AS f1_test FROM ro ORDER BY f1_test DESC, run_order LIMIT 1
""")
def q_best_model(spark, sf):
    from moodspark.plans.training import best_model
    c = _comparison(spark, sf)
    return best_model(c).select("model", r6(F.col("f1_test")).alias("f1_test"))


@query("metric_extremes", f"""
WITH {S.LABELLED}, {COMPARISON_SQL}
SELECT model, round(f1_test, 6) AS f1_test, round(accuracy_val, 6) AS accuracy_val,
  f1_test = max(f1_test) OVER () AS best_f1_test, accuracy_val = max(accuracy_val) OVER () AS best_accuracy_val,
  f1_val = min(f1_val) OVER () AS lowest_f1_val
FROM cmp
""")
def q_metric_extremes(spark, sf):
    c = _comparison(spark, sf)
    e = evaluate.metric_extremes(c, ["f1_test", "accuracy_val"], ["f1_val"])
    return e.select("model", r6(F.col("f1_test")).alias("f1_test"), r6(F.col("accuracy_val")).alias("accuracy_val"),
                    "best_f1_test", "best_accuracy_val", F.col("best_f1_val").alias("lowest_f1_val"))


# ---------------------------------------------------------------------------
# Scoring rules on score tables (SCO2, SCO3)
# ---------------------------------------------------------------------------

@query("softmax_confidence", f"""
WITH {S.LABELLED}, {SCORES_SQL}, {PRED_SQL}
SELECT doc_id, prediction,
  round(exp(s[prediction + 1] - list_max(s)) / list_sum(list_transform(s, lambda v: exp(v - list_max(s)))), 6) AS score,
  round(1 / (1 + exp(-abs(s[1]))), 6) AS binary_score
FROM pred
""")
def q_softmax_confidence(spark, sf):
    p = _predictions(spark, sf)
    return p.select("doc_id", "prediction", r6(SC.confidence("s", "prediction")).alias("score"),
                    r6(SC.confidence(F.array(F.col("s")[0]), F.lit(0))).alias("binary_score"))


@query("empty_text_rule", f"""
WITH {S.LABELLED}, {SCORES_SQL}, {PRED_SQL},
tk AS (SELECT doc_id, {S.token_string("CASE WHEN doc_id % 7 = 0 THEN '@' || source || ' !!! 123' ELSE text END")} AS tokens
       FROM documents)
SELECT p.doc_id, CASE WHEN tk.tokens = '' THEN 'neutral' ELSE {S.label_name('p.prediction')} END AS label,
  CASE WHEN tk.tokens = '' THEN 0.0 ELSE
    round(exp(p.s[p.prediction + 1] - list_max(p.s)) / list_sum(list_transform(p.s, lambda v: exp(v - list_max(p.s)))), 6)
  END AS score, tk.tokens AS tokens
FROM pred p JOIN tk ON tk.doc_id = p.doc_id
""")
def q_empty_text_rule(spark, sf):
    """SCO2 on the scored documents; every seventh comes as a text that cleans to nothing."""
    from moodspark.plans.scoring import apply_empty_rule
    noise = F.concat(F.lit("@"), F.col("source"), F.lit(" !!! 123"))
    text = F.when(F.col("doc_id") % 7 == 0, noise).otherwise(F.col("text"))
    t = tables.documents(spark, sf, "doc_id", "source", "text").select("doc_id", T.clean_and_tokenize(text).alias("tokens"))
    p = _predictions(spark, sf).select("doc_id", "prediction", SC.confidence("s", "prediction").alias("p_score"))
    out = apply_empty_rule(t.join(p, "doc_id"), "tokens", L.label_name("prediction"), F.col("p_score"))
    return out.select("doc_id", "label", r6(F.col("score")).alias("score"), "tokens")


# ---------------------------------------------------------------------------
# Statistics (AGG) and evaluation (EVA)
# ---------------------------------------------------------------------------

@query("value_counts", f"""
WITH {S.LABELLED}
SELECT {S.label_name('label')} AS sentiment_label, count(*) AS n FROM labelled GROUP BY 1
""")
def q_value_counts(spark, sf):
    d = tables.labelled_documents(spark, sf).select(L.label_name("label").alias("sentiment_label"))
    return stats.value_counts(d, "sentiment_label")


@query("class_counts", f"""
WITH {S.LABELLED}
SELECT label, count(*) AS n FROM labelled GROUP BY label
""")
def q_class_counts(spark, sf):
    return stats.class_counts(tables.labelled_documents(spark, sf), "label")


@query("class_share", f"""
WITH {S.LABELLED},
c AS (SELECT {S.label_name('label')} AS sentiment_label, count(*) AS n FROM labelled GROUP BY 1)
SELECT sentiment_label, n, round(n * 100.0 / sum(n) OVER (), 6) AS pct FROM c
""")
def q_class_share(spark, sf):
    d = tables.labelled_documents(spark, sf).select(L.label_name("label").alias("sentiment_label"))
    return stats.class_share(d, "sentiment_label").withColumn("pct", r6(F.col("pct")))


@query("dataset_profile", f"""
WITH {S.LABELLED},
c AS (SELECT source AS source_dataset, count(*) AS tweets,
  count(*) FILTER (WHERE label = 0) AS n_negative, count(*) FILTER (WHERE label = 1) AS n_neutral,
  count(*) FILTER (WHERE label = 2) AS n_positive FROM labelled GROUP BY source)
SELECT source_dataset, tweets, n_negative, n_neutral, n_positive,
  round(n_negative * 100.0 / tweets, 6) AS pct_negative, round(n_neutral * 100.0 / tweets, 6) AS pct_neutral,
  round(n_positive * 100.0 / tweets, 6) AS pct_positive FROM c WHERE tweets > 0
""")
def q_dataset_profile(spark, sf):
    d = tables.labelled_documents(spark, sf).select(F.col("source").alias("source_dataset"),
                                                    L.label_name("label").alias("sentiment_label"))
    p = stats.dataset_profile(d, "source_dataset", "sentiment_label")
    return p.withColumns({c: r6(F.col(c)) for c in p.columns if c.startswith("pct_")})


@query("dataset_share", f"""
WITH {UNION_SQL},
c AS (SELECT source_dataset, count(*) AS tweets FROM u GROUP BY source_dataset)
SELECT source_dataset, tweets, sum(tweets) OVER ()::BIGINT AS total, round(tweets * 100.0 / sum(tweets) OVER (), 1) AS share_pct
FROM c
""")
def q_dataset_share(spark, sf):
    return stats.dataset_share(_union(spark, sf), "source_dataset")


@query("funnel_counts", f"""
WITH {S.TWEETS},
k AS (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) = 1 AS keep FROM tweets),
f AS (SELECT t.doc_id, k.keep, NOT coalesce(regexp_matches(t.tweet, {S.q(T.LEADING_RT_WORD_RE)}), false) AS not_rt,
        {S.token_count(S.token_string('t.tweet'))} >= 3 AS long_enough FROM tweets t JOIN k USING (doc_id))
SELECT count(*) AS n_input,
  sum(CASE WHEN keep THEN 1 ELSE 0 END)::BIGINT AS n_deduplicated,
  sum(CASE WHEN keep AND not_rt THEN 1 ELSE 0 END)::BIGINT AS n_no_retweet,
  sum(CASE WHEN keep AND not_rt AND long_enough THEN 1 ELSE 0 END)::BIGINT AS n_min_words
FROM f
""")
def q_funnel_counts(spark, sf):
    t = _tweets(spark, sf)
    stages = [("no_retweet", ~prep.is_retweet(t, "tweet")),
              ("min_words", F.size(T.tokenize("tweet")) >= 3)]
    return stats.deduplicated_funnel(t, "text", ["source", "doc_id"], stages)


@query("corpus_funnel", lambda: ORACLE["funnel_counts"])
def q_corpus_funnel(spark, sf):
    """AGG7 + SNK6: the steps' counts, observed while the corpus is written."""
    from moodspark.sources.files import write_corpus
    t = _tweets(spark, sf)
    stages = [("no_retweet", ~prep.is_retweet(t, "tweet")),
              ("min_words", T.token_count(T.clean_and_tokenize("tweet")) >= 3)]
    path = scratch_path(spark, "funnel-corpus")
    counts = stats.write_with_funnel(t, "text", ["source", "doc_id"], stages, lambda rows: write_corpus(rows, path, "source"))
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{n} long" for n in counts))


@query("accuracy", f"""
WITH {S.LABELLED}, {SCORES_SQL}, {PRED_SQL}
SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM pred
""")
def q_accuracy(spark, sf):
    return evaluate.accuracy(_predictions(spark, sf)).select(r6(F.col("accuracy")).alias("accuracy"))


@query("f1_weighted", f"""
WITH {S.LABELLED}, {SCORES_SQL}, {PRED_SQL}, {_report_sql('pred')}
SELECT round(sum(f1 * support) / sum(support), 6) AS f1_weighted FROM rep
""")
def q_f1_weighted(spark, sf):
    s = evaluate.summary(_predictions(spark, sf))
    return s.select(r6(F.col("f1_weighted")).alias("f1_weighted"))


@query("f1_macro", f"""
WITH {S.LABELLED}, {SCORES_SQL}, {PRED_SQL}, {_report_sql('pred')}
SELECT round(avg(f1), 6) AS f1_macro FROM rep
""")
def q_f1_macro(spark, sf):
    s = evaluate.summary(_predictions(spark, sf))
    return s.select(r6(F.col("f1_macro")).alias("f1_macro"))


@query("class_report", f"""
WITH {S.LABELLED}, {SCORES_SQL}, {PRED_SQL}, {_report_sql('pred')}
SELECT cls::INTEGER AS class, support::BIGINT AS support, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1 FROM rep
""")
def q_class_report(spark, sf):
    r = evaluate.class_report(_predictions(spark, sf))
    return r.select("class", "support", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query("report_averages", f"""
WITH {S.LABELLED}, {SCORES_SQL}, {PRED_SQL}, {_report_sql('pred')}
SELECT sum(support)::BIGINT AS n, round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro,
  round(avg(f1), 6) AS f1_macro, round(sum(precision * support) / sum(support), 6) AS precision_weighted,
  round(sum(recall * support) / sum(support), 6) AS recall_weighted, round(sum(f1 * support) / sum(support), 6) AS f1_weighted
FROM rep
""")
def q_report_averages(spark, sf):
    """EVA4: macro and weighted averages."""
    s = evaluate.summary(_predictions(spark, sf))
    return s.select("n", *[r6(F.col(f"{m}_{k}")).alias(f"{m}_{k}") for k in ("macro", "weighted") for m in ("precision", "recall", "f1")])


@query("confusion_matrix", f"""
WITH {S.LABELLED}, {SCORES_SQL}, {PRED_SQL}
SELECT label, count(*) FILTER (WHERE prediction = 0) AS pred_0, count(*) FILTER (WHERE prediction = 1) AS pred_1,
  count(*) FILTER (WHERE prediction = 2) AS pred_2 FROM pred GROUP BY label
""")
def q_confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(_predictions(spark, sf))


@query("demo_accuracy", f"""
WITH {S.LABELLED}, {SCORES_SQL}, {PRED_SQL}, {TITLES_SQL},
c AS (SELECT CASE WHEN {S.expected_label("split_part(title, ' - ', 1)")} = {S.label_name('prediction')}
        THEN 'Oui' ELSE 'Non' END AS correct FROM titles)
SELECT sum(CASE WHEN correct = 'Oui' THEN 1 ELSE 0 END)::BIGINT AS correct, count(*) AS total,
  round(sum(CASE WHEN correct = 'Oui' THEN 1 ELSE 0 END) * 100.0 / count(*), 6) AS pct FROM c
""")
def q_demo_accuracy(spark, sf):
    t = _titles(spark, sf)
    flag = L.correct_flag(L.expected_label(L.title_group("title")), L.label_name("prediction"))
    a = evaluate.demo_accuracy(t.select(flag.alias("correct")))
    return a.select("correct", "total", r6(F.col("pct")).alias("pct"))


# ---------------------------------------------------------------------------
# Loaders and file sources (SRC1, SRC3, SRC4 + PRJ2 + TXT14 + FLT2)
# ---------------------------------------------------------------------------

@query("load_labelled", f"""
WITH {S.RAW},
r AS (SELECT content, {S.label_normalise('class')} AS label FROM raw WHERE content IS NOT NULL AND class IS NOT NULL),
t AS (SELECT {S.token_string('content')} AS text, label FROM r WHERE label IS NOT NULL)
SELECT text, label FROM t WHERE length(text) > 0
""")
def q_load_labelled(spark, sf):
    from moodspark.sources.columns import load_labelled
    return load_labelled(tables.raw_labelled(spark, sf))


@query("csv_roundtrip", f"""
WITH {S.LABELLED}
SELECT doc_id, label, source, text FROM labelled
""")
def q_csv_roundtrip(spark, sf):
    """SRC1: the labelled corpus written as CSV (texts hold newlines and
    quotes) and read back with an explicit schema equals the input."""
    from moodspark.sources.files import read_csv, write_csv
    path = scratch_path(spark, "labelled-csv")
    write_csv(tables.labelled_documents(spark, sf).select("doc_id", "label", "source", "text"), path)
    return read_csv(spark, path, "doc_id long, label int, source string, text string", na_to_null=False)


@query("glob_capped_scan", f"""
WITH {LINES_SQL}
SELECT key, lang FROM (SELECT key, lang, row_number() OVER (PARTITION BY lang ORDER BY key) AS r FROM lines) WHERE r <= 1500
""")
def q_glob_capped_scan(spark, sf):
    """SRC3: a CSV folder for each language's lines, read by glob with at most 1,500
    rows of each, ordered by key.  A folder has a part file for each task that had
    rows of it, so a language that most rows have is written and read in parallel."""
    from moodspark.sources.files import read_glob_capped
    root = scratch_path(spark, "clean-csv")
    (_lines(spark, sf).select("key", "line", "lang").write.mode("overwrite").option("header", "true")
     .option("escape", '"').partitionBy("lang").csv(root))
    # a line has no line break, so files can be split among tasks
    df = read_glob_capped(spark, root, "*.csv", 1500, order="key", schema="key long, line string, lang string",
                          per_folder=True, multiLine="false")
    return df.select("key", "lang")


# Irregular forms that the registered query brings along, of words that the corpora hold.
QUERY_EXCEPTIONS = [("was", "wa"), ("was", "be"), ("this", "that"), ("der", "die"), ("les", "le"), ("thes", "the")]


def _lemmas_sql() -> str:
    """The rules as one row a form; ``toks`` holds the corpus, whose words are the word set."""
    def made(src: str, last: int) -> str:
        ways = " UNION ALL ".join(
            f"SELECT word, {last + 1} AS round, place * {len(prep.NOUN_RULES)} + {i} AS place, "
            f"substr(form, 1, length(form) - {len(end)}) || '{new}' AS form FROM {src} WHERE round = {last} AND ends_with(form, '{end}')"
            for i, (end, new) in enumerate(prep.NOUN_RULES))
        return ways

    exc = ", ".join(f"({S.q(w)}, {S.q(x)})" for w, x in QUERY_EXCEPTIONS)
    later = [f"form{i} AS ({made(f'form{i - 1}', i - 1)})" for i in range(1, prep.RULE_ROUNDS + 1)]
    every = " UNION ALL ".join([f"SELECT word, 0, -1, word FROM words"]
                               + [f"SELECT word, {i - 1}, place, form FROM form{i}" for i in range(1, prep.RULE_ROUNDS + 1)]
                               + ["SELECT word, 0, row_number() OVER (PARTITION BY word ORDER BY lemma), lemma FROM exc"])
    return f"""
words AS (SELECT DISTINCT unnest(tokens) AS word FROM toks), exc(word, lemma) AS (VALUES {exc}),
form0 AS (SELECT word, 0 AS round, 0 AS place, word AS form FROM words WHERE word NOT IN (SELECT word FROM exc)),
{", ".join(later)},
forms(word, round, place, form) AS ({every}),
lem AS (SELECT word, arg_min(form, (round, length(form), place)) AS lemma FROM forms
        WHERE form IN (SELECT word FROM words) AND word IN (SELECT word FROM words) GROUP BY word)"""


@query("lemmatize", f"""
WITH {S.LABELLED}, {TOKS_SQL}, {_lemmas_sql()},
u AS (SELECT doc_id, unnest(tokens) AS tok, unnest(generate_series(1, len(tokens))) AS i FROM toks),
m AS (SELECT u.doc_id, u.i, coalesce(lem.lemma, u.tok) AS x FROM u LEFT JOIN lem ON u.tok = lem.word),
g AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS lemmas FROM m GROUP BY doc_id)
SELECT t.doc_id, coalesce(g.lemmas, '') AS lemmas FROM toks t LEFT JOIN g USING (doc_id)
""")
def q_lemmatize(spark, sf):
    """TXT12: noun lemmas by ending rules and exceptions; the corpus's words are the word set."""
    t = reliable_checkpoint(_labelled_tokens(spark, sf).select("doc_id", "tokens"))
    words = t.select(F.explode("tokens").alias("word")).distinct()
    exceptions = spark.createDataFrame(QUERY_EXCEPTIONS, "word string, lemma string")
    lem = reliable_checkpoint(prep.noun_lemmas(t, "tokens", words, exceptions))
    out = prep.lemmatize(t, "doc_id", "tokens", lem)
    return out.select("doc_id", F.array_join("tokens", " ").alias("lemmas"))


@query("corpus_sink", f"""
WITH {S.TWEETS}, {LEX_SQL}
SELECT t.doc_id, t.tweet, {S.clean('t.tweet')} AS tweet_clean, {S.token_string('t.tweet')} AS tweet_tokens,
  length({S.clean('t.tweet')})::INTEGER AS tweet_length,
  CASE WHEN sc.sentiment_score >= 0.05 THEN 'positive' WHEN sc.sentiment_score <= -0.05 THEN 'negative'
    ELSE 'neutral' END AS sentiment_label,
  round(sc.sentiment_score, 6) AS sentiment_score, t.source AS source_dataset
FROM tweets t JOIN sc USING (doc_id)
""")
def q_corpus_sink(spark, sf):
    """SNK6 + PRJ11 + LAB1/LAB2: the cleaned, lexicon-labelled corpus written as
    Parquet partitioned by source and read back."""
    from moodspark.sources.files import write_corpus
    # cleaned once; the columns and the lexicon read the result
    c = reliable_checkpoint(prep.derived_columns(_tweets(spark, sf), "tweet", F.col("source")).select(
        "doc_id", "tweet", "tweet_clean", "tweet_tokens", "tweet_length", "source_dataset"))
    words = c.select("doc_id", T.split_words("tweet_clean").alias("words"))
    s = lexicon.lexicon_score(words, "doc_id", "words", lexicon.lexicon_table(spark, QUERY_LEXICON))
    corpus = c.join(s, "doc_id").select(
        "doc_id", "tweet", "tweet_clean", "tweet_tokens", "tweet_length",
        lexicon.score_label().alias("sentiment_label"),
        r6(F.col("sentiment_score")).alias("sentiment_score"), "source_dataset")
    path = write_corpus(corpus, scratch_path(spark, "corpus"))
    return spark.read.parquet(path).select("doc_id", "tweet", "tweet_clean", "tweet_tokens", "tweet_length",
                                           "sentiment_label", "sentiment_score", "source_dataset")


@query("comparison_csv", f"""
WITH {S.LABELLED}, {COMPARISON_SQL}
SELECT model, round(accuracy_val, 6) AS accuracy_val, round(f1_val, 6) AS f1_val,
  round(accuracy_test, 6) AS accuracy_test, round(f1_test, 6) AS f1_test FROM cmp
""")
def q_comparison_csv(spark, sf):
    """SNK1: the comparison table, best first, written as one header CSV and read back."""
    from moodspark.sources.files import read_csv, write_csv
    cols = ["accuracy_val", "f1_val", "accuracy_test", "f1_test"]
    c = _comparison(spark, sf).orderBy(F.desc("f1_test"), "run_order").select("model", *[r6(F.col(x)).alias(x) for x in cols])
    path = write_csv(c, scratch_path(spark, "comparison-csv"), single_file=True)
    return read_csv(spark, path, "model string, " + ", ".join(f"{x} double" for x in cols))


def _report_lines_sql() -> str:
    def fixed(x):
        n = f"floor(({x}) * 100.0 + 0.5)::BIGINT"
        return f"(({n}) // 100)::VARCHAR || '.' || lpad((({n}) % 100)::VARCHAR, 2, '0')"

    def line(name, *cells):
        return f"rpad({name}, 12, ' ')" + "".join(f" || lpad({c}, 12, ' ')" for c in cells)

    n = "sum(support)::BIGINT::VARCHAR"
    avg = {"macro avg": "avg({})", "weighted avg": "sum({} * support) / sum(support)"}
    rows = [f"SELECT 0 AS line_no, {line(S.q(''), *map(S.q, ('precision', 'recall', 'f1-score', 'support')))} AS line",
            f"SELECT cls::INTEGER + 1, {line(S.label_name('cls::INTEGER'), *[fixed(m) for m in ('precision', 'recall', 'f1')], 'support::BIGINT::VARCHAR')} FROM rep",
            f"SELECT 1001, {line(S.q('accuracy'), S.q(''), S.q(''), fixed('sum(recall * support) / sum(support)'), n)} FROM rep"]
    rows += [f"SELECT {1002 + i}, {line(S.q(name), *[fixed(f.format(m)) for m in ('precision', 'recall', 'f1')], n)} FROM rep"
             for i, (name, f) in enumerate(avg.items())]
    return " UNION ALL ".join(rows)


@query("report_text", f"""
WITH {S.LABELLED}, {SCORES_SQL}, {PRED_SQL}, {_report_sql('pred')}
SELECT line FROM ({_report_lines_sql()})
""")
def q_report_text(spark, sf):
    """SNK3: the classification report (header, classes, accuracy, averages) written
    as a text file and read back."""
    from moodspark.sources.files import write_text_lines
    lines = evaluate.report_lines(_predictions(spark, sf)).orderBy("line_no")
    path = write_text_lines(lines, "line", scratch_path(spark, "report"), single_file=True)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("modelling_report")
def q_modelling_report(spark, sf):
    """SNK3: the final report: sizes, the comparison table, the best model, and
    every model's classification report; written as text and read back."""
    from moodspark.plans.training import best_model, comparison_from_predictions
    from moodspark.sources.files import write_text_lines
    corpus = docs, vocab, _ = _nb_corpus(spark, sf)
    pred = reliable_checkpoint(_model_predictions(corpus))
    size = {r["split"]: r["n"] for r in docs.groupBy("split").agg(F.count("*").alias("n")).collect()}
    table = comparison_from_predictions(pred)
    rows = table.orderBy(F.desc("f1_test"), "run_order").collect()    # one a model
    best = best_model(table).first()
    lines = ["MODELLING REPORT", "",
             f"Documents: {sum(size.values()):,}",
             f"Train/val/test: {size.get('train', 0):,} / {size.get('val', 0):,} / {size.get('test', 0):,}",
             f"Vocabulary: {vocab.count():,} terms", "", "COMPARISON",
             f"{'model':<12}" + "".join(f"{c:>16}" for c in ("accuracy_val", "f1_val", "accuracy_test", "f1_test"))]
    lines += [f"{r['model']:<12}" + "".join(f"{r[c]:>16.4f}" for c in ("accuracy_val", "f1_val", "accuracy_test", "f1_test"))
              for r in rows]
    lines += ["", f"BEST MODEL: {best['model']}", f"F1 test: {best['f1_test']:.4f}", ""]
    for m in MODEL_ALPHAS:
        own = pred.where((F.col("model") == m) & (F.col("split") == "test"))
        lines += [f"REPORT - {m}", *[r["line"] for r in evaluate.report_lines(own).orderBy("line_no").collect()], ""]
    out = spark.createDataFrame(list(enumerate(lines)), "line_no int, line string").orderBy("line_no")
    path = write_text_lines(out, "line", scratch_path(spark, "modelling-report"), single_file=True)
    return spark.read.text(path).select(F.col("value").alias("line"))


# ---------------------------------------------------------------------------
# Model jobs (rows-only checks; properties in tests/)
# ---------------------------------------------------------------------------

def _corpus(spark, sf):
    """The labelled corpus, split; all rows of the train part are fitted on."""
    from moodspark.plans.training import prepare_corpus
    return prepare_corpus(tables.labelled_documents(spark, sf), sample_per_class=None)


def _fitted(spark, sf, name, corpus=None):
    """A model fitted on the train part, saved and loaded."""
    from moodspark.plans import training
    corpus = _corpus(spark, sf) if corpus is None else corpus
    train = corpus.where(F.col("split") == "train")
    model, _ = training.fit_classifier(name, training.fit_features(train), train)
    return training.load_model(training.save_model(model, scratch_path(spark, f"model-{name}")))


def _train(name):
    """MOD1-MOD5: fit on the train part; predictions of all val and test rows."""
    def run(spark, sf):
        from moodspark.plans.training import predict
        corpus = _corpus(spark, sf)
        return predict(_fitted(spark, sf, name, corpus), corpus.where(F.col("split") != "train"))
    return run


for _name, _model in [("train_logreg", "logreg"), ("train_nb", "naive_bayes"), ("train_svm", "svm"),
                      ("train_forest", "forest"), ("train_gbt", "boosting")]:
    query(_name)(_train(_model))


@query("train_any_table")
def q_train_any_table(spark, sf):
    """SRC4 to MOD1: a foreign table's columns and label spellings are resolved, and a
    model is trained on what they give."""
    from moodspark.plans.training import prepare_corpus, train_and_predict
    from moodspark.sources.columns import load_labelled
    loaded = load_labelled(tables.raw_labelled(spark, sf), keep=["doc_id"])
    return train_and_predict(prepare_corpus(loaded, tokenised=True), "logreg")


@query("model_comparison")
def q_model_comparison(spark, sf):
    """MOD1-MOD5 + MOD10 + SNK1: one row per model with val/test metrics, 5-fold CV
    mean/std and training seconds, best first, written as CSV and read back."""
    from moodspark.plans.training import compare_models
    from moodspark.sources.files import read_csv, write_csv
    table = compare_models(_corpus(spark, sf)).orderBy(F.desc("f1_test"), "run_order")
    path = write_csv(table, scratch_path(spark, "model-comparison"), single_file=True)
    return read_csv(spark, path, table.schema)


@query("grid_search")
def q_grid_search(spark, sf):
    """MOD9: best (C, n-gram) by 3-fold macro F1; refit scored on val/test."""
    from moodspark.plans import training
    corpus = _corpus(spark, sf)
    model, params = training.grid_search(corpus.where(F.col("split") == "train"))
    m = training.metrics(model, corpus)
    row = [(float(params["best_C"]), int(params["best_ngram_max"]), float(params["cv_f1_macro"]),
            m.get("f1_macro_val"), m.get("f1_macro_test"))]
    return spark.createDataFrame(row, "best_C double, best_ngram_max int, cv_f1_macro double, "
                                      "f1_macro_val double, f1_macro_test double")


@query("variant_compare")
def q_variant_compare(spark, sf):
    """MOD12 (+ MOD7, MOD8 estimators, SNK4 run log, SNK2 export of the best)."""
    from moodspark.plans.training import variant_compare
    return variant_compare(_corpus(spark, sf), runs_path=scratch_path(spark, "runs"),
                           export_path=scratch_path(spark, "best-variant"))


def _requests(spark, sf):
    """Scoring requests: every conversation turn, ordinal = (conv_id, turn)."""
    c = tables.conversation_turns(spark, sf)
    return c.select("conv_id", "turn", "text")


@query("score_batch")
def q_score_batch(spark, sf):
    """SCO1-SCO4: every conversation turn scored by the SVM trained on the
    labelled documents; label, confidence, tokens; input order kept."""
    from moodspark.plans.scoring import score
    return score(_fitted(spark, sf, "svm"), _requests(spark, sf), "text", keep=["conv_id", "turn"]).orderBy(
        "conv_id", "turn")


@query("score_stream")
def q_score_stream(spark, sf):
    """SCO5: the same scoring as a Structured Streaming query over the
    conversation files (available-now trigger), read back from its sink."""
    from moodspark.streaming.scoring import score_stream
    model = _fitted(spark, sf, "svm")
    schema = tables.read_table(spark, sf, "conversations").schema
    q, sink = score_stream(spark, model, sf, schema, "text", ["conv_id", "turn"],
                           glob="conversations.parquet")
    q.awaitTermination()
    return spark.read.parquet(sink).drop("batch_id")


@query("model_roundtrip")
def q_model_roundtrip(spark, sf):
    """SNK2 + SRC6: save the fitted pipeline, load it, score with the loaded copy."""
    from moodspark.plans.scoring import score
    from moodspark.plans.training import load_model, save_model
    path = save_model(_fitted(spark, sf, "logreg"), scratch_path(spark, "model"))
    return score(load_model(path), _requests(spark, sf), "text", keep=["conv_id", "turn"])


def _best_run(corpus, sums):
    """The best model of the comparison: its name, metrics, params and test report."""
    from moodspark.plans import training
    docs, vocab, _ = corpus
    pred = reliable_checkpoint(_model_predictions(corpus, sums))
    b = training.best_model(training.comparison_from_predictions(pred)).first()
    own = pred.where((F.col("model") == b["model"]) & (F.col("split") == "test"))
    cv = _cv_summary(corpus, MODEL_ALPHAS[b["model"]]).first()
    size = {r["split"]: r["n"] for r in docs.groupBy("split").agg(F.count("*").alias("n")).collect()}
    params = {"model_name": b["model"], "tfidf_features": vocab.count(), "tfidf_ngram_range": "(1, 2)",
              "train_size": size.get("train", 0), "val_size": size.get("val", 0), "test_size": size.get("test", 0),
              "max_per_class": training.SAMPLE_PER_CLASS, "label_names": L.LABEL_NAMES}
    metrics = {k: float(b[k]) for k in ("accuracy_val", "f1_val", "accuracy_test", "f1_test")}
    metrics |= {"cv_f1_mean": float(cv["cv_f1_mean"]), "cv_f1_std": float(cv["cv_f1_std"])}
    return b["model"], params, metrics | training.class_metrics(own), evaluate.report_lines(own)


@query("registry_version")
def q_registry_version(spark, sf):
    """SNK5: the best model's sums are saved and registered twice, with its params,
    metrics and report; versions 1 and 2."""
    import time

    from moodspark.plans.training import REGISTRY_SCHEMA, register
    reg, path = scratch_path(spark, "registry"), scratch_path(spark, "nb-model")
    began = time.perf_counter()
    # one corpus and one model for what is saved and for what is compared
    corpus = _nb_corpus(spark, sf)
    sums = _nb_sums(corpus)
    sums.write.parquet(path)
    seconds = time.perf_counter() - began
    _, params, metrics, report = _best_run(corpus, sums)
    for _ in range(2):
        register(spark, reg, "sentiment-best", path, {**metrics, "train_time_s": seconds}, params, report)
    return spark.read.schema(REGISTRY_SCHEMA).parquet(reg).select("name", "version", "path", "params", "metrics", "report")


@query("runs_table")
def q_runs_table(spark, sf):
    """SNK4: one run row per model of the comparison table, with its test report."""
    from moodspark.plans.training import RUN_SCHEMA, comparison_from_predictions, log_run
    path = scratch_path(spark, "runs")
    pred = reliable_checkpoint(_model_predictions(_nb_corpus(spark, sf)))
    for r in comparison_from_predictions(pred).collect():  # one row per model (bounded)
        own = pred.where((F.col("model") == r["model"]) & (F.col("split") == "test"))
        log_run(spark, path, r["model"], {"run_order": r["run_order"], "alpha": MODEL_ALPHAS[r["model"]]},
                {k: r[k] for k in ("accuracy_val", "f1_val", "accuracy_test", "f1_test")}, evaluate.report_lines(own))
    return spark.read.schema(RUN_SCHEMA).parquet(path).select("run", "params", "metrics", "report")


_METRICS = ("accuracy_val", "f1_val", "accuracy_test", "f1_test")


@query("registry_metrics", f"""
WITH {S.LABELLED}, {COMPARISON_SQL},
ro AS (SELECT *, list_position({S.sql_list(list(MODEL_ALPHAS))}, model) AS run_order FROM cmp),
best AS (SELECT * FROM ro ORDER BY f1_test DESC, run_order LIMIT 1)
SELECT 'sentiment-best' AS name, v.version, model, {", ".join(f"round({m}, 6) AS {m}" for m in _METRICS)}
FROM best, (SELECT unnest([1, 2])::BIGINT AS version) v
""")
def q_registry_metrics(spark, sf):
    """SNK5: the registry's entries as columns."""
    r = q_registry_version(spark, sf)
    return r.select("name", "version", F.element_at("params", "model_name").alias("model"),
                    *[r6(F.element_at("metrics", m)).alias(m) for m in _METRICS])


@query("runs_metrics", f"""
WITH {S.LABELLED}, {COMPARISON_SQL}
SELECT model AS run, CASE model {" ".join(f"WHEN {S.q(m)} THEN {a!r}" for m, a in MODEL_ALPHAS.items())} END::DOUBLE AS alpha,
  {", ".join(f"round({m}, 6) AS {m}" for m in _METRICS)} FROM cmp
""")
def q_runs_metrics(spark, sf):
    """SNK4: the run log's params and metrics as columns."""
    r = q_runs_table(spark, sf)
    return r.select("run", F.element_at("params", "alpha").cast("double").alias("alpha"),
                    *[r6(F.element_at("metrics", m)).alias(m) for m in _METRICS])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_word_top120(spark, sf_dir)
