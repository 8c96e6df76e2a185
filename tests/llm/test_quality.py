"""Quality classifier: held-out accuracy, defined results in odd cases."""

import numpy as np

from cohortry.llm.quality import QualitySettings, features, good_documents, quality_scores


def tables(spark, sf):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")


def test_held_out_accuracy(spark):
    docs, labels = tables(spark, "sf0.1")
    scored = quality_scores(docs, labels).join(labels, "doc_id").where("held_out and quality is not null").collect()
    good = [r for r in scored if r.quality == 1]
    bad = [r for r in scored if r.quality == 0]
    assert sum(r.predicted == 1 for r in good) >= 0.99 * len(good)
    assert sum(r.predicted == 0 for r in bad) >= 0.9 * len(bad)


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = tables(spark, "sf0.01")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality")
    a = {r.doc_id: r.score for r in quality_scores(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality_scores(docs, turned).collect()}
    assert a == b


def test_odd_rows(spark):
    docs, labels = tables(spark, "sf0.001")
    odd = spark.createDataFrame(
        [(None, "some text", "x"), (-1, None, "x"), (-2, "", "x"), (-3, "word " * 200_000, "x"), (-3, "word " * 200_000, "x")],
        "doc_id long, text string, score string",
    )
    got = quality_scores(docs.select("doc_id", "text").unionByName(odd, allowMissingColumns=True), labels).collect()
    assert len(got) == docs.count() + 5
    by = {r.doc_id: r for r in got}
    assert by[-1].score == by[-2].score and 0 <= by[-1].score <= 1
    assert all(r.predicted == int(r.score >= 0.3) for r in got)
    none = labels.where("false")
    assert {r.score for r in quality_scores(odd, none).collect()} == {0.5}
    assert quality_scores(odd.where("false"), labels).collect() == []
    assert good_documents(odd, none).columns == odd.columns


def test_features_are_sparse_and_bounded():
    at, x = features(b"One two three!! 44 one", 1 << 12)
    assert at.max() < 1 << 12 and len(at) == len(x)
    assert features(b"", 16)[0].tolist() == [0]
    assert np.isfinite(x).all()
    assert QualitySettings().max_rows == 20_000
