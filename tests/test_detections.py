"""Detections with rectangles, the verifier's lines, readers and remediation on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from veilspark import policy_values as V
from veilspark.operators import detections, labels, spatial
from veilspark.plans.engine import Engine
from veilspark.policy import Policy
from veilspark.sources import policies, tables
from veilspark.verify import independent

WORDS = "array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>"
LINES = f"doc_id int, page int, block int, line int, ord int, text string, x0 double, y0 double, x1 double, y1 double, words {WORDS}"
RULES = independent.Rules({c: V.DIRECT_PATTERNS[c] for c in ("email", "street_address")}, labels.LABEL, labels.LABEL_VALUE, V.FEET_INCHES, terms=("Oak Harbor",), boilerplate=("by others",))


def line(ord, block, text, y, x=0.0):
    at, words = x, []
    for w in text.split(" "):
        words.append((w, at, y, at + 5.0 * len(w), y + 10))
        at += 5.0 * len(w) + 5
    return (1, 1, block, ord, ord, text, x, y, at - 5, y + 10, words)


def found(df):
    return sorted((r.category, r.text, r.rect.x0, r.rect.y0, r.rect.x1, r.suppressed_by) for r in df.collect())


def test_lines_give_patterns_by_block_and_terms_by_page(spark):
    lines = [line(0, 0, "Write to ann@example.org now", 0.0), line(1, 0, "12 Sycamore", 20.0), line(2, 0, "Street", 40.0), line(3, 1, "14 Sycamore", 60.0), line(4, 2, "Road Harbor", 80.0), line(5, 3, "Bay LLC", 100.0)]
    got = found(detections.line_detections(spark.createDataFrame(lines, LINES), Policy(terms=("Harbor Bay",))))
    plain = [g[:5] for g in got]
    assert ("email", "ann@example.org", 45.0, 0.0, 120.0) in plain  # the word, not the line
    assert ("street_address", "12 Sycamore\nStreet", 0.0, 20.0, 55.0) in plain and ("street_address", "12 Sycamore\nStreet", 0.0, 40.0, 30.0) in plain
    assert not [g for g in plain if g[1].startswith("14")]  # patterns stay in a block
    assert [g[2:4] for g in plain if g[0] == "denylist"] == [(0.0, 100.0), (25.0, 80.0)]  # terms cross blocks


def test_matches_read_their_lines_without_a_join(spark):
    lines = spark.createDataFrame([line(0, 0, "12 Sycamore", 0.0), line(1, 0, "Street", 20.0)], LINES)
    made = detections.block_matches(lines, Policy(terms=("Sycamore Street",)))
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()  # before, each match met all lines of its page
    assert sorted((r.category, r.rect.y0, r.context) for r in made.collect()) == [(c, y, "12 Sycamore\nStreet") for c in ("denylist", "street_address") for y in (0.0, 20.0)]


def test_table_cells_rule_out_fragile_matches_only(spark):
    lines = spark.createDataFrame([line(0, 0, "12 Sycamore Street", 0.0), line(1, 1, "ann@example.org bob@example.org", 20.0)], LINES)
    cells = spark.createDataFrame([(1, 1, k, (20.0 * k, 0.0, 20.0 * k + 20, 40.0)) for k in range(5)], "doc_id int, page int, cell_id int, rect struct<x0:double,y0:double,x1:double,y1:double>")
    got = {g[0]: g[5] for g in found(detections.line_detections(lines, Policy(), cells))}
    assert got["street_address"] == "table_zone:multi_cell_street_address" and got["email"] is None


def test_a_line_with_its_own_value_labels_no_other(spark):
    lines = spark.createDataFrame([line(0, 0, "Owner: Harbor Holdings", 0.0), line(1, 0, "CLIENT", 20.0), line(2, 0, "Maren Oldfield", 40.0)], LINES)
    got = [(g[1], g[2]) for g in found(detections.line_detections(lines, Policy())) if g[0] == "labelled_identifier"]
    assert got == [("Harbor Holdings", 35.0), ("Maren Oldfield", 0.0)]


def test_no_lines(spark):
    assert found(detections.line_detections(spark.createDataFrame([], LINES), Policy(terms=("Harbor Bay",)))) == []


def test_words_give_the_same_policy_in_points(spark):
    rows = [(1, 1, 1, 1, 2, "Bay", 0, 40, 30, 20), (1, 1, 1, 1, 1, "Harbor", 70, 0, 60, 20), (1, 1, 1, 1, 1, "of", 40, 2, 20, 20), (1, 1, 2, 1, 1, "OWNER:", 0, 100, 60, 20), (1, 1, 3, 1, 1, "Maren", 4, 130, 50, 20), (1, 1, 3, 1, 1, "Oldfield", 60, 130, 80, 20), (1, 1, 4, 1, 1, "Faraway", 0, 900, 70, 20)]
    words = spark.createDataFrame(rows, "doc_id int, page int, block int, par int, line int, text string, left int, top int, width int, height int")
    assert [r.text for r in detections.ocr_lines(words).orderBy("ord").collect()] == ["of Harbor", "Bay", "OWNER:", "Maren Oldfield", "Faraway"]
    got = [g[:5] for g in found(detections.ocr_detections(words, Policy(terms=("Harbor Bay",)), 2.0))]
    assert got == [("denylist", "Harbor\nBay", 0.0, 20.0, 15.0), ("denylist", "Harbor\nBay", 35.0, 0.0, 65.0), ("labelled_identifier", "Maren Oldfield", 2.0, 65.0, 70.0)]


def test_search_ends_at_the_first_line_too_far_down(spark):
    rows = [(1, 0, "OWNER:", 0.0), (1, 1, "Harbor Holdings", 20.0), (1, 2, "Footer", 500.0), (1, 3, "Bay Partners", 40.0)]
    lines = spark.createDataFrame(rows, "doc_id int, ord int, text string, y0 double").selectExpr("*", "0D x0", "90D x1", "y0 + 10 AS y1")
    assert [r.value for r in labels.following_values(lines).collect()] == ["Harbor Holdings"]


def test_verifier_lines(spark):
    rows = [(1, 1, 0, 5, "Oak", 0.0, 0.0), (1, 1, 1, 5, "Harbor", 0.0, 20.0), (1, 1, 2, None, "the Oak-Harbor", 0.0, 40.0), (1, 1, 3, None, "OWNER", 0.0, 60.0), (1, 1, 4, None, "12'", 0.0, 70.0), (1, 1, 5, None, "Maren  Oldfield", 0.0, 80.0), (1, 1, 6, None, "later text", 0.0, 90.0), (1, 1, 7, None, "3.2 12 Sycamore Street", 300.0, 400.0), (1, 1, 8, None, "12 Sycamore Street", 300.0, 420.0), (1, 1, 9, None, "14 Sycamore Road by others", 300.0, 440.0)]
    lines = spark.createDataFrame(rows, "doc_id int, page int, ord int, grp int, text string, x0 double, y0 double").selectExpr("*", "x0 + 90 AS x1", "y0 + 8 AS y1")
    assert {r.category: r.hits for r in independent.scan_lines(lines, RULES).collect()} == {"denylist": 2, "labelled_identifier": 1, "street_address": 1}
    spans = spark.createDataFrame([(1, 1, 0, 0, 1, "bor ", 0.0), (1, 1, 0, 0, 0, " Har", 0.0), (1, 1, 0, 1, 0, "  ", 0.0)], "doc_id int, page int, block int, line int, span int, text string, x0 double").selectExpr("*", "0D y0", "9D x1", "9D y1")
    assert [r.text for r in independent.lines_of_spans(spans).collect()] == ["Harbor"]
    assert independent.read_terms('{"a": ["Bay", {"b": " Harbor "}], "_c": "Private", "d": "no"}') == ["Harbor", "Bay"]


def test_policy_files(spark, tmp_path):
    assert policies.read_policy(tmp_path / "none", terms=("Q",)) == Policy(("Q",), frozenset(), frozenset(), (), (), ())
    (tmp_path / policies.DEFINED_FILE).write_text(json.dumps({"terms": ["Landlord", 3], "strip_chars": " .", "strip_affixes": ["'s"]}))
    (tmp_path / policies.STRUCTURAL_FILE).write_text(json.dumps({"suppress_if_span_matches": [{"name": "grid", "pattern": "[A-Z]-\\d"}, {"name": "none"}]}))
    (tmp_path / "allow.json").write_text(json.dumps({"strip_suffixes": ["GmbH"], "entries": [{"source": ["Not a name"], "makers": ["Muster GmbH", " "]}, "x"]}))
    policy = policies.read_policy(tmp_path, tmp_path / "allow.json")
    assert (policy.defined, policy.allowed, policy.structural) == ({"landlord"}, {"muster"}, (("grid", "[A-Z]-\\d"),))
    from veilspark.operators.suppress import suppression_reason

    texts = spark.createDataFrame([("Landlord's.",), ("MUSTER, GmbH",), ("b-7",), ("Owner",)], "t string")
    assert [r[0] for r in texts.select(suppression_reason(F.col("t"), policy)).collect()] == ["contract_defined_term:landlord", "shared_allowlist:muster", "structural:grid", None]
    (tmp_path / policies.BOILERPLATE_FILE).write_text("[1]")
    with pytest.raises(ValueError):
        policies.read_policy(tmp_path)


def test_settings(spark, tmp_path):
    path = tmp_path / "settings.json"
    path.write_text(json.dumps({"ocr_dpi": 200, "regions": [{"name": "seal", "rect": [0.5, 0, 1, 0.25]}, {"enabled": False, "rect": []}, {"rect": [0, 0, 1, 1], "pages": [2]}]}))
    made = policies.read_settings(path)
    assert (made.ocr_dpi, made.barcode_dpi, [r.pages for r in made.regions]) == (200, 120, [None, (2,)])
    assert [(r.name, r.all_pages) for r in policies.regions_frame(spark, made).collect()] == [("seal", True), ("configured-region", False)]
    for bad in ({"ocr_dpi": 100}, {"ocr_dpi": "x"}, {"regions": [{"rect": [0.5, 0, 0.4, 1]}]}, {"regions": [{}]}, {"ner": []}, {"ner": {"threshold": 2}}, {"resource_limits": {"retention_days": 0}}):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            policies.read_settings(path)


def test_label_export_is_whole_or_unchanged(spark, tmp_path):
    item = ("i", 0, [0.0, 0.0, 1.0, 1.0], 1.0, "person", "sensitive", "redact", None)
    good, bad = (spark.createDataFrame([("d", "p.pdf", n, "now", [item])], tables.LABEL_SCHEMA) for n in (1, 0))
    for _ in range(2):  # a second export replaces the first
        path = tables.write_labels(spark, good, str(tmp_path))
    with pytest.raises(ValueError):
        tables.write_labels(spark, bad, str(tmp_path))
    assert [r.doc_id for r in spark.read.schema(tables.LABEL_SCHEMA).json(path).collect()] == ["d"]


def test_patched_documents_fail(spark):
    docs = spark.createDataFrame([(1, "Call (850) 555-0100"), (2, "nothing"), (3, None)], "doc_id int, text string")
    got = {r.doc_id: (r.text, r.remediated, r.passed) for r in Engine(Policy()).remediate(docs).collect()}
    assert got == {1: ("Call [PHONE]", ["phone"], False), 2: ("nothing", [], True), 3: (None, [], True)}


def test_margin_images(spark):
    top, middle, big = (10.0, 10.0, 60.0, 40.0), (200.0, 300.0, 260.0, 340.0), (0.0, 0.0, 600.0, 150.0)
    rows = [(1, p, i, r) for p in (1, 2, 3) for i, r in ((7, top), (7, top), (8, middle), (9, big), (0, top))] + [(1, 1, 5, top), (1, 2, 5, top)] + [(1, 4, 7, top)] * 12
    images = spark.createDataFrame(rows, "doc_id int, page int, image_id int, rect struct<x0:double,y0:double,x1:double,y1:double>")
    pages = spark.createDataFrame([(1, p, 612.0, 792.0) for p in (1, 2, 3, 4)], "doc_id int, page int, width double, height double")
    kept, crowded = spatial.repeated_margin_images(images, pages, crowd=10)
    assert sorted((r.page, r.image_id) for r in kept.collect()) == [(1, 7), (2, 7), (3, 7)] and [r.page for r in crowded.collect()] == [4]
