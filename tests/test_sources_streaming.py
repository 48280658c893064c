import json

import pytest

from veilspark.operators.triage import latest_decisions
from veilspark.plans import queries
from veilspark.plans.engine import Engine
from veilspark.policy import Policy
from veilspark.sources import tables
from veilspark.streaming import streams


def test_terms_labels_and_publish(spark, tmp_path):
    (tmp_path / "terms.json").write_text(json.dumps({"owner": ["Bay Holdings", "x"], "_note": ["Never This One"], "firm": "Harbor Group"}))
    assert sorted(r.term for r in tables.read_terms(spark, str(tmp_path / "terms.json"), skip_private=True).collect()) == ["Bay Holdings", "Harbor Group"]
    (tmp_path / "words.tsv").write_text("\t".join("level page_num block_num par_num line_num word_num left top width height conf text".split()) + '\n5\t1\t1\t1\t1\t1\t2\t3\t4\t5\t90\t"a\n5\t1\t1\t1\t1\t2\t2\t3\t4\t5\t90\t \n')
    assert [r.text for r in tables.read_ocr_words(spark, str(tmp_path / "words.tsv")).collect()] == ['"a']
    item = {"id": "i", "page": 0, "bbox": [1, 2, 3, 4], "scale": 2.0, "category": "firm", "sensitivity": "sensitive", "disposition": "redact", "note": None}
    for k, (change, message) in enumerate([({}, None), ({"page": 5}, "page out of range: i"), ({"bbox": [3, 2, 1, 4]}, "bad bbox: i"), ({"category": "cat"}, "unknown category: i")]):
        (tmp_path / f"l{k}.json").write_text(json.dumps({"doc_id": "d", "source_pdf": "s", "page_count": 1, "exported_at": "t", "items": [item | change]}))
        got = tables.label_violations(tables.read_labels(spark, str(tmp_path / f"l{k}.json"))).collect()
        assert [r.message for r in got] == ([message] if message else [])
    where = tables.publish(spark, {"t": spark.range(3)}, str(tmp_path / "runs"), "r1")
    assert spark.read.parquet(f"{where}/t").count() == 3
    with pytest.raises(FileExistsError):
        tables.publish(spark, {"t": spark.range(3)}, str(tmp_path / "runs"), "r1")


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(1, "mail a.b@example.com"), (2, "nothing")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs"))
    streams.redact_stream(stream, Engine(Policy())).writeStream.format("memory").queryName("found").trigger(availableNow=True).start().awaitTermination()
    assert [r.match for r in spark.table("found").where("category = 'email'").collect()] == ["a.b@example.com"]
    rows = spark.createDataFrame([("f", "safe", "h", 1), ("f", "sensitive", "h", 2)], "finding_id string, disposition string, output_sha256 string, decided_at long")
    rows.write.parquet(str(tmp_path / "in"))
    streams.upsert_decisions(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), spark.read.parquet).awaitTermination()
    assert [r.disposition for r in latest_decisions(spark.read.parquet(str(tmp_path / "out/v0"))).collect()] == ["sensitive"]


def test_entry_and_queries_have_counterparts(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(queries.ORACLES) >= 60
    rows = entry.entry(spark).collect()
    assert len(rows) == 12
