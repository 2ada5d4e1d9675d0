import __spark_entry__ as contract
import corpus_pipeline
from rollmark.llm.queries import QUERIES, SQL


def test_all_operators_are_registered():
    names = list(contract.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(names) and set(SQL) <= set(contract.oracle_sql())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "mixing", "token_output"]


def test_pipeline_stages_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kinds = docs.dtypes
    bad = {r.doc_id for r in contract.queries()["op9_toxicity"](spark, small).filter("predicted = 1").collect()}
    ids = [{r.doc_id for r in docs.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.dtypes == kinds, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert ids[1] == ids[0] - bad and ids[0] > ids[2] and ids[1] >= ids[2] >= ids[3] >= ids[4]
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert len(rows) == docs.count() and {r.doc_id for r in rows} == ids[4]
