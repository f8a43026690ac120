import corpus_pipeline as cp
from rows import SCHEMA, documents

from tauframe.llm import near_dedup, pieces, pii, quality_rules


def test_stages_hand_on_documents(spark, tmp_path):
    docs = spark.createDataFrame(documents(), SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in cp.STAGES:
        out = stage(spark, seen[-1], str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/{name}"))
        if name != "sentencepiece":
            assert seen[-1].columns == columns
    kept = {r.doc_id for r in quality_rules.apply_policies(quality_rules.ledger(docs)).where(
        f"kept_{quality_rules.CURRENT.version}").collect()}
    assert {r.doc_id for r in seen[1].collect()} == kept
    assert {r.doc_id for r in seen[2].collect()} == {
        r.doc_id for r in near_dedup.near_duplicates(seen[1]).where("kept").collect()}
    assert seen[3].count() == seen[2].count()
    assert not any(r.base_spans for r in pii.find(seen[3], None).collect())
    assert {r.doc_id for r in seen[4].collect()} <= {r.doc_id for r in seen[3].collect()}
    rows = sorted(map(str, seen[5].collect()))
    assert rows == sorted(map(str, pieces.describe_documents(seen[4]).collect()))
    assert sorted(map(str, cp.run(spark, str(tmp_path)).collect())) == rows


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
