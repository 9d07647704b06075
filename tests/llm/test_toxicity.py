import zlib

import numpy as np

from moodspark.llm import queries, toxicity
from tests.llm import helpers as H

BAD = ["vileword", "grimterm"]


def corpus(n=600, seed=1):
    """Long clean documents; a toxic one holds one bad word in one of its sentences."""
    rng = np.random.default_rng(seed)
    words = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for d in range(n):
        s = [[words[k] for k in rng.integers(0, 200, 8)] for _ in range(rng.integers(3, 12))]
        toxic = d % 4 == 0
        if toxic:
            s[rng.integers(len(s))][3] = BAD[d // 4 % 2] + "xyz"[d % 3]
        rows.append((d, ". ".join(" ".join(x) for x in s) + "."))
        labels.append((d, int(toxic)))
    return rows, labels


def test_learns_and_locates(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.classify(docs, lab).collect()
    text, toxic = dict(rows), dict(labels)
    assert {r["doc_id"]: r["held_out"] for r in out} == {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in text}
    held = [r for r in out if r["held_out"]]
    assert np.mean([r["predicted"] == toxic[r["doc_id"]] for r in held]) >= 0.97
    hit = [r for r in out if r["predicted"] and toxic[r["doc_id"]]]
    assert np.mean([any(b in text[r["doc_id"]][r["worst_start"]:r["worst_end"]] for b in BAD) for r in hit]) >= 0.97
    kept = toxicity.keep_clean(docs, toxicity.train(docs, lab))
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in out if not r["predicted"]}


def test_held_out_labels_are_not_used(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(d, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, t in labels]
    a, b = (toxicity.train(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert (a.feature == b.feature).all() and (a.weight == b.weight).all() and a.bias == b.bias


def test_noisy_or_gradient():
    """The fitted scores are the noisy-or of the sentences' scores."""
    from moodspark.llm.common import utf8
    import pyarrow as pa

    rows, labels = corpus(100)
    data, offsets = utf8(pa.array([t for _, t in rows]))
    model = toxicity.fit(data, offsets, np.array([t for _, t in labels], bool), np.ones(100))
    p, *_ = toxicity.document_scores(model, data, offsets)
    for i in range(0, 100, 7):
        raw = rows[i][1].encode()
        parts = [s for s in raw.split(b".")]
        each = []
        for s in parts[:-1]:
            one, off = np.frombuffer(s, np.uint8), np.array([0, len(s)])
            each.append(1 / (1 + np.exp(-model.sentence_margins(toxicity.sentences(one, off))[0])))
        assert abs(p[i] - (1 - np.prod(1 - np.array(each)))) < 1e-6


def test_query(spark, sf_small):
    rows = queries.QUERIES["op9_toxicity"](spark, sf_small).collect()
    assert len(rows) == len(H.documents(sf_small))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_edges(spark):
    df = H.edge_rows(spark, "toxic", "score", "held_out")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(1, 1), (1, 0), (4, None), (None, 1), (7, 0), (8, 0)], "doc_id long, toxic int")
    for labels in (none, odd):
        out = toxicity.classify(df, labels).collect()
        assert len(out) == len(H.EDGES) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.classify(H.empty_table(spark), odd).count() == 0


def test_held_out_accuracy(spark):
    """On rows whose labels no fit and no setting has seen."""
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES["op9_toxicity"](spark, sf).where("held_out").collect() if r.doc_id in labels]
    toxic, clean = ([r.predicted for r in rows if labels[r.doc_id] == c] for c in (1, 0))
    assert len(toxic) > 50 and sum(toxic) / len(toxic) > .8 and sum(clean) / len(clean) < .01


def test_texts_beyond_the_sample_s_bytes_are_passed_over(spark):
    rows, labels = corpus(60)
    long = [(1000, "fine words here. " * 70_000), (1001, "x" * 2_000_000)]
    lab = spark.createDataFrame(labels + [(1000, 0), (1001, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows + long, "doc_id long, text string")
    a, b = (toxicity.train(d, lab, sample_bytes=1 << 20) for d in (docs, docs.where("doc_id < 1000")))
    assert (a.feature == b.feature).all() and a.bias != 0
    few = toxicity.train(docs, lab, sample_bytes=1000)
    assert len(few.feature) <= len(a.feature)
    assert toxicity.classify(docs, lab).where("doc_id >= 1000").count() == 2
