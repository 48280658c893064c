"""The pipeline's stages on the small driver table, each against what its operator says of its own input."""

from collections import Counter

import corpus_pipeline
from veilspark.llm import decontaminate
from veilspark.llm.mixing import mix_report
from veilspark.llm.ngram_join import NgramJoin
from veilspark.llm.quality import score_documents

SF = "/root/testdata/sf0.001"


def test_each_stage_does_its_whole_job(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        if name != "sharding":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        ids, before = Counter(r.doc_id for r in out.select("doc_id").collect()), {r.doc_id for r in now.select("doc_id").collect()}
        if name == "quality":
            assert set(ids) == {r.doc_id for r in score_documents(spark, now, labels).where("predicted = 1").collect()}
        elif name == "near_duplicates":
            assert set(ids) == {r.doc_id for r in NgramJoin(spark).result(now).where("doc_id = component_id").collect()}
        elif name == "decontamination":
            assert set(ids) == before - {r.doc_id for r in decontaminate.find_leaks(spark, now, bench).collect()}
        elif name == "mixing":
            assert ids == Counter({r.doc_id: r.taken // r["size"] for r in mix_report(spark, now).collect() if r.taken})
        else:
            assert sum(ids.values()) == now.count() and out.select("shard", "slot").distinct().count() == now.count()
        now = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
