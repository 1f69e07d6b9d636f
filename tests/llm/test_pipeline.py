import corpus_pipeline
from gridmine.llm import ngram_join, quality, token_files


def test_stages_one_after_the_other(spark, docs, rows, tmp_path, monkeypatch):
    sf = str(tmp_path)
    text = {d: t for d, t, _ in rows}
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, " ".join(text[7].split(" ")[2:16]))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "mixing", "token_files"]
    now = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, sf)
        now.write.parquet(f"{sf}/{k}")
        now = spark.read.parquet(f"{sf}/{k}")
        if k < 4:
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append([r["doc_id"] for r in now.collect()])
    kept = {r["doc_id"] for r in quality.quality_digest(docs).where("kept").collect()}
    assert set(seen[0]) == kept
    one = {r["doc_id"] for r in ngram_join.near_duplicate_sets(spark.read.parquet(f"{sf}/0")).where("doc_id = component_id").collect()}
    assert {d for d in seen[1] if d is not None} == one
    assert set(seen[1]) - set(seen[2]) == {7} & set(seen[1])
    assert set(seen[3]) <= set(seen[2]) and set(seen[4]) == set(seen[3]) and len(seen[4]) == len(seen[3])
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()), key=str) == sorted(map(tuple, now.collect()), key=str)
    again = token_files.token_files(spark.read.parquet(f"{sf}/3"))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, now.collect()), key=str)
