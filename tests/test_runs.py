"""Grid joins against brute force, and what runs keep, on small inputs."""

import random
import re
from datetime import UTC, datetime

from pyspark.sql import functions as F

from veilspark import policy_values as V
from veilspark.operators import evaluate, runs, spatial

RECT = "struct<x0:double,y0:double,x1:double,y1:double>"


def boxes(rng, n, docs=3, dense=False):
    out = []
    for i in range(n):
        x, y = (rng.uniform(0, 60), rng.uniform(0, 40)) if dense else (rng.uniform(-50, 600), rng.uniform(0, 790))
        out.append((rng.randrange(docs), 1 + rng.randrange(2), i, (x, y, x + rng.choice([0, 5, 40, 300]), y + rng.choice([0, 3, 12, 100]))))
    return out


def meets(a, b):
    return min(a[2], b[2]) > max(a[0], b[0]) and min(a[3], b[3]) > max(a[1], b[1])


def test_overlapping_matches_every_pair(spark):
    rng = random.Random(1)
    for dense in (False, True):  # the second is one crowded corner of a page
        a, b = boxes(rng, 150, dense=dense), boxes(rng, 150, dense=dense)
        x, y = (spark.createDataFrame(r, f"doc_id int, page int, {n} int, {n}_rect {RECT}") for r, n in ((a, "a"), (b, "b")))
        got = sorted((r.a, r.b) for r in spatial.overlapping(x, y, ["doc_id", "page"], "a_rect", "b_rect").collect())
        assert got == sorted((i[2], j[2]) for i in a for j in b if i[:2] == j[:2] and meets(i[3], j[3])) and got


def test_items_meet_findings_of_several_pages(spark):
    rng = random.Random(2)
    near = [(0, i, i % 2, (10.0 * i, 5.0, 10.0 * i + 30, 17.0), rng.choice(["contact", "person", "address"])) for i in range(60)]
    found = [(0, rng.randrange(2), k, [1] if k % 3 else [1, 2, 2], (10.0 * k + 2, 5.0, 10.0 * k + 33, 16.0), rng.choice([*V.EQUIVALENT, "unknown"])) for k in range(60)]
    items = spark.createDataFrame(near, f"doc_id int, item_id int, page int, rect {RECT}, category string")
    rows = spark.createDataFrame(found, f"doc_id int, surface int, ord int, page array<int>, rect {RECT}, category string")

    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        inner = max(0, w) * max(0, h)
        return inner / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inner)

    want = []
    for _, item, page, rect, label in near:
        fits = [(s, o, c) for _, s, o, pages, r, c in found if page + 1 in pages and label in V.EQUIVALENT.get(c, ()) and iou(rect, r) >= V.IOU_MATCH]
        if fits:
            want.append((0, item, *min(fits)))
    assert sorted(tuple(r) for r in evaluate.match_items(items, rows).collect()) == want and want


def test_spans_points_and_names(spark):
    words = [("Harbor", 0.0, 0.0, 30.0, 10.0), ("Bay", 35.0, 1.0, 50.0, 11.0), ("LLC", 55.0, 0.0, 70.0, 10.0)]
    df = spark.createDataFrame([(words, 7, 10, (0.0, 0.0, 70.0, 11.0)), (words, 0, 8, (0.0, 0.0, 70.0, 11.0)), (words, 90, 95, (1.0, 2.0, 3.0, 4.0))], f"words array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>, s int, e int, line {RECT}")
    got = [tuple(r.r) for r in df.select(runs.span_rect(F.col("words"), F.col("s"), F.col("e"), F.col("line")).alias("r")).collect()]
    assert got == [(35.0, 1.0, 50.0, 11.0), (0.0, 0.0, 50.0, 11.0), (1.0, 2.0, 3.0, 4.0)]
    assert tuple(df.select(runs.points(F.col("line"), F.lit(2.0)).alias("r")).first().r) == (0.0, 0.0, 35.0, 5.5)
    assert re.fullmatch(r"20260102T030405\.000006Z-[0-9a-f]{8}", runs.run_id(datetime(2026, 1, 2, 3, 4, 5, 6, UTC)))


def test_manifest_and_batches(spark):
    rows = spark.createDataFrame([(1, "FAIL", 3, 1), (2, "AUTOMATED_PASS", 4, 0), (3, "FAIL", 1, 1)], "doc_id long, release_status string, pages int, rendered int")
    text = runs.summary(runs.manifest_payload(rows, "r1"))
    assert "3 documents, 8 pages, 2 rendered" in text and "- FAIL: 2" in text
    batch = spark.createDataFrame([(1, False), (2, None), (3, False)], "ord int, failed boolean")
    assert [r.state for r in runs.until_failure(batch).orderBy("ord").collect()] == ["done", "FAIL", "not_started"]
    assert {r.state for r in runs.until_failure(batch.where("failed is not null")).collect()} == {"done"}
    empty = rows.limit(0)
    assert runs.run_statistics(empty).first().pages == 0 and runs.manifest_payload(empty, "r").count() == 1
    checks = spark.createDataFrame([(1, "a", True), (1, "b", None), (2, "a", True)], "doc_id int, check string, ok boolean")
    assert sorted((r.doc_id, r.passed, r.failed) for r in runs.checks_pass(checks).collect()) == [(1, False, ["b"]), (2, True, [])]
