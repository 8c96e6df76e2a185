"""Pipeline stages on a small table, each held against what its operator says."""

import corpus_pipeline
from cohortry.llm.decontaminate import leaks
from cohortry.llm.quality import quality_scores
from cohortry.llm.suffixes import without_repeats


def first_of_near_copies(rows):
    """Smallest id of every group reachable over pairs with a Jaccard index of 0.8 or more on five-word runs, by all pairs."""
    sets = {}
    for i, text in rows:
        words = (text or "").lower().split()
        width = max(1, min(5, len(words)))
        sets[i] = frozenset(hash(tuple(words[k : k + width])) for k in range(len(words) - width + 1))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {find(i) for i in ids}


def test_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, benchmark = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "decontamination", "mixture"]
    seen = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], sf_dir).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
        if k < 4:
            assert seen[-1].dtypes == docs.dtypes, name
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(seen[1]) == {r.doc_id for r in quality_scores(docs, labels).collect() if r.predicted == 1}
    want = first_of_near_copies([(r.doc_id, r.text) for r in seen[1].collect()])
    kept = [r.doc_id for r in seen[2].collect()]
    assert sorted(kept) == sorted(want)
    cut = {r.doc_id: r.kept for r in without_repeats(seen[2], as_text=True).collect()}
    after = {r.doc_id: (r.text, r.n_chars) for r in seen[3].collect()}
    assert after == {d: (t, len(t)) for d, t in cut.items() if t or d in after}
    assert ids(seen[4]) == ids(seen[3]) - {r.doc_id for r in leaks(seen[3], benchmark).collect()}
    assert ids(seen[5]) <= ids(seen[4]) and seen[5].count() > 0
    assert set(docs.columns) < set(seen[5].columns)


def test_empty_documents(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0, name


def test_odd_rows(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    odd = spark.createDataFrame([(None, None, None, None, None), (5000, "", None, "src0", 0), (5000, "", None, "src0", 0), (5001, "tail " * 90, "en", None, None)], docs.schema)
    docs = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() > 0, name
