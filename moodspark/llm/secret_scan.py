"""Secret scan with corpus-wide ownership frequency; DataFrame functions only.

Every text is searched for three base kinds and one wider kind of candidate.
The hash of each candidate's value is counted over the corpus by distinct
owners and repositories.  A value that few owners hold in few repositories looks like
a live credential; one that many hold, or that one owner has everywhere, is an example
that has been copied around.  The
wider kind (``opaque``: long strings of mixed letters and digits) adds spans
only where ownership marks them live; base spans always stay.

A pattern's positions come from the lengths of what lies between its matches
(``split`` and ``regexp_extract_all``), summed up over a text's matches, so a text
takes time in proportion to its length and its matches.

Defined results: a null or empty text has no spans; a null owner or repository
counts as one of its own, named ''; repeated rows (also of one id) give a row
each and count as one owner; spans of one start are ordered as the kinds are
listed; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodspark.llm.common import sha256_hex
from moodspark.session import reliable_checkpoint


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


KEYS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + f"|{either_case('api')}_?{either_case('key')}"
ASSIGN = rf"""({KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind: pattern, group with the value, least length of the value.  A run of one
#: class of characters that is too short holds no longer one, so those patterns
#: carry their least length themselves.
KINDS = {
    "assign": (ASSIGN, 2, 6),
    "access": ("AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": ("[0-9a-f]{24,}", 0, 24),
    "opaque": ("[A-Za-z0-9_-]{24,}", 0, 24),
}
BASE = ("assign", "access", "hex")
#: At most so many owners, and so many repositories of theirs, hold a live-looking value.
LIVE_OWNERS, LIVE_REPOSITORIES = 2, 4
#: Values in more rows than this are so few that their counts may be broadcast.
HOT_ROWS = 1_000_000


def matches(text: Column, kind: str) -> Column:
    """``struct<kind_no, gaps, hits>``: lengths of what lies before each match, and the matches."""
    pattern, *_ = KINDS[kind]
    return F.struct(F.lit(list(KINDS).index(kind)).alias("kind_no"),
                    F.transform(F.split(text, pattern, -1), F.length).alias("gaps"),
                    F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               owner_col: str = "source", repository_col: str = "lang") -> DataFrame:
    """A row for each input row: ``row, doc_id, owner, repository, parts`` (the kinds that match)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                      F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
                      F.coalesce(F.col(repository_col).cast("string"), F.lit("")).alias("repository"))
            .select("doc_id", "owner", "repository",
                    F.filter(F.array(*[matches(text, k) for k in KINDS]), lambda p: F.size(p["hits"]) > 0).alias("parts"))
            .withColumn("row", F.monotonically_increasing_id()))


def found_in(docs: DataFrame) -> DataFrame:
    """``row, doc_id, owner, repository, start, kind_no, end, value_hash`` of each candidate."""
    each = (docs.select("row", "doc_id", "owner", "repository", F.explode("parts").alias("p"))
            .select("row", "doc_id", "owner", "repository", "p.kind_no",
                    F.posexplode(F.arrays_zip(F.col("p.gaps").alias("gap"), F.col("p.hits").alias("hit"))).alias("i", "x"))
            .where(F.col("x.hit").isNotNull()))
    end = F.sum(F.col("x.gap") + F.length("x.hit")).over(Window.partitionBy("row", "kind_no").orderBy("i"))
    hit = F.col("x.hit")
    value, keep = F.lit(None).cast("string"), F.lit(False)
    for no, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        own = F.regexp_extract(hit, pattern, group) if group else hit
        fits = F.length(own) >= least
        if kind == "opaque":
            fits = fits & own.rlike("[A-Z]") & own.rlike("[a-z]") & own.rlike("[0-9]")
        value = F.when(F.col("kind_no") == no, own).otherwise(value)
        keep = F.when(F.col("kind_no") == no, fits).otherwise(keep)
    return (each.withColumn("end", end.cast("int")).where(keep)
            .select("row", "doc_id", "owner", "repository", (F.col("end") - F.length(hit)).alias("start"), "kind_no", "end",
                    sha256_hex(value).alias("value_hash")))


def ownership(found: DataFrame) -> DataFrame:
    """``value_hash, n_rows, n_repositories, n_owners`` over the corpus.

    A repository belongs to its owner.  Each step sums up what the one before
    has counted, so a value that a third of all rows hold leaves each task once.
    """
    return (found.groupBy("value_hash", "owner", "repository").agg(F.count("*").alias("n"))
            .groupBy("value_hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("r"))
            .groupBy("value_hash").agg(F.sum("n").alias("n_rows"), F.sum("r").alias("n_repositories"),
                                       F.count("*").alias("n_owners")))


def scan_secrets(df: DataFrame, live_owners: int = LIVE_OWNERS, id_col: str = "doc_id", text_col: str = "text",
                 owner_col: str = "source", repository_col: str = "lang",
                 live_repositories: int = LIVE_REPOSITORIES) -> DataFrame:
    """A row for each input row with its spans; see the module's text."""
    # the texts are searched once: what was found is small and read twice
    docs = reliable_checkpoint(candidates(df, id_col, text_col, owner_col, repository_col))
    found = reliable_checkpoint(found_in(docs))
    owners = reliable_checkpoint(ownership(found))
    # a value in very many rows is one join key: such values are few, and broadcast
    hot = F.broadcast(owners.where(F.col("n_rows") > HOT_ROWS))  # at most rows / HOT_ROWS
    counted = found.join(hot, "value_hash").unionByName(
        found.join(hot, "value_hash", "left_anti").join(owners.where(F.col("n_rows") <= HOT_ROWS), "value_hash"))
    live = (F.col("n_owners") <= live_owners) & (F.col("n_repositories") <= live_repositories)
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind_no") + 1)
    base = F.col("kind_no") < len(BASE)
    kept = (counted.where(base | live)
            .select("row", "doc_id", F.struct(
                "start", "kind_no", "end", F.concat_ws(":", kind, "start", "end").alias("said"),
                live.alias("live")).alias("s")))
    by_row = kept.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    without = (docs.where(F.size("parts") == 0)
               .select("row", "doc_id", F.lit(None).cast(by_row.schema["s"].dataType).alias("s")))
    # a row whose only matches are too short or copied examples of the wider kind
    dropped = (docs.where(F.size("parts") > 0).select("row", "doc_id")
               .join(by_row.select("row"), "row", "left_anti")
               .withColumn("s", F.lit(None).cast(by_row.schema["s"].dataType)))
    rows = by_row.unionByName(without).unionByName(dropped).select(
        "doc_id", F.coalesce("s", F.array().cast(by_row.schema["s"].dataType)).alias("s"))

    def number(test) -> Column:
        return F.size(F.filter("s", test)).cast("long")

    def of_kind(i: int):
        return lambda x: x["kind_no"] == i

    def said(test) -> Column:
        return F.array_join(F.transform(F.filter("s", test), lambda x: x["said"]), ",")

    return rows.select(
        "doc_id",
        *[number(of_kind(i)).alias(f"n_{k}") for i, k in enumerate(BASE)],
        sha256_hex(said(lambda x: x["kind_no"] < len(BASE))).alias("base_sha256"),
        said(lambda x: F.lit(True)).alias("spans"),
        number(lambda x: x["live"]).alias("n_live"),
        number(lambda x: ~x["live"]).alias("n_example"))


def _sql() -> str:
    """The same in DuckDB's SQL."""
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    parts = []
    for no, (kind, (pattern, group, least)) in enumerate(KINDS.items()):
        value = f"regexp_extract(h, {quoted(pattern)}, {group})" if group else "h"
        also = f" AND regexp_matches({value}, '[A-Z]') AND regexp_matches({value}, '[a-z]') AND regexp_matches({value}, '[0-9]')" if kind == "opaque" else ""
        parts.append(f"""
SELECT doc_id, source, lang, {no} AS no, '{kind}' AS kind, upto - length(h) AS a, upto AS b, {value} AS v FROM (
 SELECT doc_id, source, lang, h, sum(length(g) + length(h)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM (
  SELECT doc_id, source, lang, i, gaps[i] AS g, hits[i] AS h FROM (
   SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT doc_id, source, lang, string_split_regex(text, {quoted(pattern)}) AS gaps,
           regexp_extract_all(text, {quoted(pattern)}, 0) AS hits FROM documents))))
WHERE length({value}) >= {least}{also}""")
    return f"""
WITH found AS ({" UNION ALL ".join(parts)}),
owners AS (SELECT v, count(DISTINCT coalesce(source, '')) <= {LIVE_OWNERS}
  AND count(DISTINCT (coalesce(source, ''), coalesce(lang, ''))) <= {LIVE_REPOSITORIES} AS live FROM found GROUP BY v),
kept AS (SELECT f.*, o.live FROM found f JOIN owners o ON f.v = o.v WHERE no < {len(BASE)} OR o.live),
by_doc AS (
 SELECT doc_id, {", ".join(f"count(*) FILTER (no = {i}) AS n_{k}" for i, k in enumerate(BASE))},
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, no) FILTER (no < {len(BASE)}) AS base,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, no) AS spans,
  count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
 FROM kept GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)},
 sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
 coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM documents d LEFT JOIN by_doc b ON d.doc_id = b.doc_id"""


ORACLE = _sql()
