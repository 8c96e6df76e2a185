"""Toxicity: held-out accuracy, labels that must not matter, odd rows."""

from cohortry.llm.toxicity import toxicity_scores


def tables(spark, sf):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")


def test_held_out_accuracy(spark):
    docs, labels = tables(spark, "sf0.1")
    rows = toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out and toxic is not null").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.04 * len(clean)


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = tables(spark, "sf0.01")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - toxic else toxic end as toxic")
    a = {r.doc_id: r.score for r in toxicity_scores(docs, labels).collect()}
    b = {r.doc_id: r.score for r in toxicity_scores(docs, turned).collect()}
    assert a == b


def test_odd_rows(spark):
    docs, labels = tables(spark, "sf0.01")
    odd = spark.createDataFrame([(None, "you idiot", "x"), (-1, None, "x"), (-2, "", "x"), (-3, "word " * 200_000, "x"), (-3, "word", "x")], "doc_id long, text string, score string")
    got = toxicity_scores(docs.select("doc_id", "text").unionByName(odd, allowMissingColumns=True), labels).collect()
    assert len(got) == docs.count() + 5
    by = {r.doc_id: r for r in got}
    assert by[-1].score == by[-2].score
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.score for r in toxicity_scores(odd, labels.where("false")).collect()} == {0.5}
    assert toxicity_scores(odd.where("false"), labels).collect() == []
