"""The pipeline's stages against brute force over a small table."""

from collections import Counter

from pyspark.sql import functions as F
from test_operators import brute_components, words

import corpus_pipeline as P


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    steps = dict(P.STAGES)
    one = steps["language_id"](spark, docs, small)
    assert one.columns == columns and {r["doc_id"] for r in docs.subtract(one).collect()} == {r["doc_id"] for r in docs.collect() if not any(c.isalpha() for c in r["text"] or "")}
    two = steps["ngram_jaccard_join"](spark, one, small)
    groups = brute_components([(r["doc_id"], r["text"]) for r in one.collect()])
    assert two.columns == columns and {r["doc_id"] for r in two.collect()} == {d for d, (_, c) in groups.items() if d == c}
    three = steps["decontamination"](spark, two, small)
    items = [" ".join(w.decode() for w in words(r["text"])) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    left = {r["doc_id"]: " ".join(w.decode() for w in words(r["text"])) for r in three.collect()}
    assert three.columns == columns and not any(i in t for t in left.values() for i in items)
    gone = {r["doc_id"] for r in two.collect()} - set(left)
    assert len(gone) <= 0.2 * two.count()
    four = steps["mixing"](spark, three, small)
    copies = Counter(r["doc_id"] for r in four.collect())
    assert four.columns == columns and set(copies) <= set(left) and max(copies.values()) <= 2
    five = P.token_ids(spark, four, small)
    assert five.count() == four.count()
    got = sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in P.run(spark, small).collect())
    assert [g[1] for g in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]
    assert Counter(g[0] for g in got) == copies


def test_clashing_columns_and_rows_without_id(spark, small):
    docs = spark.createDataFrame([(None, "Der Hund lief und der Mann ging nach Haus", "de", "a", 1, "x"), (1, "the dog ran and the man went home", "en", "a", 1, "x"), (2, None, None, None, 1, "x")], "doc_id long, text string, lang string, source string, score int, lang_pred string")
    kept = P.ngram_jaccard_join(spark, P.language_id(spark, docs, small), small)
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1] and kept.columns == docs.columns
    assert P.decontamination(spark, docs, small).count() == 3
