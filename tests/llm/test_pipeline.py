"""The pipeline against a plain version of its stages."""

import re

import corpus_pipeline as P
from pyspark.sql import functions as F

from lodeseek.llm.quality import quality_scores


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = P.run(spark, data).collect()
    score = {r.doc_id: r.result.score for r in quality_scores(docs, spark.read.parquet(f"{data}/labels.parquet")).collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if score[r.doc_id] >= P.QUALITY}
    best = {}
    for i, t in sorted(rows.items(), key=lambda x: (-len(x[1] or ""), x[0])):
        best.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), i)
    rows = {i: rows[i] for i in sorted(best.values())}
    sets, comp = {i: shingles(t) for i, t in rows.items()}, {i: i for i in rows}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in rows:
        for b in rows:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                comp[max(find(a), find(b))] = min(find(a), find(b))
    rows = {i: t for i, t in rows.items() if find(i) == i}
    split = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    bench = {tuple(w[k : k + 10]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect() for w in [split(r.text)] for k in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(w) for w in bench}
    dirty = lambda w: any(tuple(w[k : k + n]) in bench for n in sizes for k in range(len(w) - n + 1))
    rows = {i: t for i, t in rows.items() if not dirty(split(t))}
    assert sorted(r.doc_id for r in got) == sorted(rows)
    assert all(r.n_tokens == len((rows[r.doc_id] or "").encode().lower().split()) for r in got)


def test_stages_keep_columns_and_take_odd_rows(spark, data):
    odd = [(1, None, "en", "s", 0, "x"), (2, "", "en", "s", 0, "x"), (3, "same words here for all", None, "s", None, "x"), (4, "same  words here for all", "en", None, 1, "x"), (4, "same  words here for all", "en", None, 1, "x"), (None, "lone", "en", "s", 1, "x")]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, result long, kept string")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns, name
        assert out.count() <= 6 and stage(spark, docs.limit(0), data).count() == 0
    kept = P.STAGES[1][1](spark, docs, data)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "None"]
    assert P.STAGES[-1][1](spark, docs, data).count() == 6
    assert docs.where(F.col("doc_id").isNull()).count() == 1


def test_repeated_and_missing_ids(spark, data):
    """Rows go one by one: no text is lost that has no copy, and one row of each group stays."""
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "A  same text"), (5, "A same text"), (5, "a unique text that stands alone"), (8, "twice the same row"), (8, "twice the same row"), (None, "twice the same row"), (None, None), (None, "")]
    near = [(9, words), (9, words + " x1"), (3, words + " x2"), (None, words + " x3"), (3, "another lone text of words that no row shares")]
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in rows + near], "doc_id long, text string, row_number string, n long")
    left = P.STAGES[1][1](spark, docs, data)
    assert left.columns == docs.columns
    want = [(1, "A  same text"), (5, "a unique text that stands alone"), (8, "twice the same row"), *near]
    got = [(r.doc_id, r.text) for r in left.collect()]
    assert sorted(map(repr, (g for g in got if g[1]))) == sorted(map(repr, want)) and sum(not g[1] for g in got) == 1
    after = P.STAGES[2][1](spark, left, data)
    got = [(r.doc_id, r.text) for r in after.collect() if r.text]
    assert after.columns == docs.columns
    assert sorted(map(repr, got)) == sorted(map(repr, [*want[:3], (3, words + " x2"), near[-1]]))
