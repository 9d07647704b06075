"""Inputs and brute-force restatements shared by the operators' tests."""

from __future__ import annotations

import random

import duckdb

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

EDGES = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " ", None, None, 1), (4, "x", "en", "b", 1),
    (5, "\n\n", "de", "b", 2), (6, "é😀 ß\u0000 x", "fr", "a", 8), (7, "same text here now", "en", "a", 18),
    (7, "same text here now", "en", "a", 18), (None, "a row without an id", "en", "a", 19), (8, "w " * 3000, "en", "c", 6000),
    (9, "z" * 5000, "en", "c", 5000),
]


def edge_rows(spark, *clashing: str):
    """Odd rows, with extra columns of the given names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGES, DOCS).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in clashing})


def empty_table(spark):
    return spark.createDataFrame([], DOCS)


def documents(sf_dir: str):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def same_as_sql(df, con, sql: str) -> None:
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == sorted(df.columns)
    place = [names.index(c) for c in df.columns]
    want = sorted(repr(tuple(r[i] for i in place)) for r in res.fetchall())
    assert sorted(repr(tuple(r)) for r in df.collect()) == want


def near_copies(n: int = 120, seed: int = 7):
    """Copies of one text with word edits, short texts, and texts that share a passage."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [rnd.choice(words) for _ in range(120)]
    rows = []
    for i in range(n):
        k = rnd.random()
        if k < .5:
            w = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 4, 6, 9])):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            rows.append((i, " ".join(w[:rnd.randrange(90, 120)] if rnd.random() < .3 else w)))
        elif k < .7:
            rows.append((i, " ".join(rnd.choice("aAbB") for _ in range(rnd.randrange(0, 9)))))
        else:
            rows.append((i, "\t".join(base[20:60]) + " \n" + " ".join(rnd.choice(words) for _ in range(rnd.randrange(40)))))
    return rows + [(7, rows[7][1]), (None, "a b c d e"), (None, None), (900, None), (901, ""), (902, "x y"), (903, "X  y"),
                   (3, rows[8][1]), (904, " ".join(base * 50)), (905, " ".join(base * 50) + " z")]
