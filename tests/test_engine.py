import random
import re
from collections import Counter
from statistics import fmean

import pytest
from pyspark.sql import functions as F

from veilspark import policy, policy_values as V
from veilspark.functions import text as T
from veilspark.operators import evaluate, labels, layout, ner, propose, report, scan, suppress, triage, zones
from veilspark.operators.redact import redact
from veilspark.plans import queries
from veilspark.plans.engine import Engine
from veilspark.policy import Policy
from veilspark.verify import independent

TEXTS = [
    "Write to a.b@example.com or call (850) 555-0199 ext. 4\nsee https://x.example.org/a and plans.com",
    "Owner: Bay Holdings\n4120 Sycamore Boulevard\nPanama City, FL 32401",
    "😀 é jo@ab.de, Permit # A-12345; Parcel No. 44-1; PROJECT NO.: 21109-A",
    r"C:\Users\x\21109 plan.rvt" + "\nby Dawn Kirkland, AIA\nP.O. Box 12",
    "Job QRX - 21109 and QRX\n21109 but QRX211090",
    "at 30.1588, -85.6602 or 30° 9' 12\" N",
    "", None, "nothing here \u0001 at all",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_every_match_and_offset_agrees_with_a_plain_matcher(spark, docs):
    pol = Policy(terms=("QRX-21109", "Bay Holdings"))
    got = sorted((r.doc_id, r.category, r.start, r.end, r.match) for r in scan.scan(docs, policy=pol).collect())
    patterns = {**V.DIRECT_PATTERNS, "denylist": policy.denylist_pattern(pol.terms)}
    want = sorted((i, c, m.start(), m.end(), m[0]) for i, t in enumerate(TEXTS) if t for c, p in patterns.items() for m in re.finditer(p, t.replace("\u0001", " ")))
    assert got == want and len({g[1] for g in got}) == 13


def test_counts_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    texts = ["call +1 (989) 555-0525 st\u00e4 des", "850 555-0100 850 555-0101", "1 555-0100\u00a0Oak St", "at 1.12345,2.12345;3.12345,4.12345", "\u00e9ab@x.org", "lot no.\u0001 A-77", "850 555-0100\n", "b\u00fcro.com\u00e4 www.\u00e9", "12 Par\u212away", "1 a \u017ft", "12\x0bOak St", None, ""] + TEXTS
    spark.createDataFrame([(i % 5, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(queries.ORACLES["count_by_category"]).fetchall())
    assert sorted(map(tuple, queries.QUERIES["count_by_category"](spark, str(tmp_path)).collect())) == want


def test_equal_values_are_ruled_once_and_counted_all(spark):
    rows = spark.createDataFrame([("Owner's", "party")] * 5 + [(None, "party")] * 2 + [("Hatco", "manufacturer")] * 3, "term string, verdict string")
    once = suppress.distinct_rows(rows, "term", "verdict")
    assert sorted(r.n for r in once.collect()) == [2, 3, 5] and once.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    made = [sorted(map(tuple, evaluate.outcomes(evaluate.classify(x, Policy(terms=("Hatco",)))).collect())) for x in (rows, once)]
    assert made[0] == made[1] == [("manufacturer", 3, 0, 0, 3), ("party", 0, 5, 2, 5)]
    ruled = [sorted(map(tuple, report.rule_counts(x.withColumn("rule", suppress.suppression_reason(F.col("term"), Policy())).where("rule is not null")).collect())) for x in (rows, once)]
    assert ruled[0] == ruled[1] == [("contract_defined_term", 5), ("shared_allowlist", 3)]


def test_clean_texts_are_not_looked_at_again(spark, docs):
    e = Engine(Policy(terms=("QRX-21109",)))
    plain, marked = e.redact(docs), e.redact(docs, mark=True)
    rows = {r.doc_id: r for r in marked.collect()}
    assert {k: r.text for k, r in rows.items()} == {r.doc_id: r.text for r in plain.collect()} and all(r.text == TEXTS[k] for k, r in rows.items() if r.clean) and {6, 7, 8} <= {k for k, r in rows.items() if r.clean} and not rows[0].clean
    assert sorted(map(tuple, e.sweep(marked).select("doc_id", "text").collect())) == sorted(map(tuple, e.sweep(plain).collect()))
    false_mark = docs.where("doc_id = 0").withColumn("clean", F.lit(True))
    assert e.residuals(false_mark).count() == 0 and e.residuals(docs.where("doc_id = 0")).count() > 0 and e.sweep(false_mark).first().text == TEXTS[0]


def test_no_terms_match_nothing(docs):
    assert policy.denylist_pattern(()) is None
    assert scan.scan(docs, categories=("email", "denylist"), policy=Policy()).where("category = 'denylist'").count() == 0


@pytest.mark.parametrize("text, reason", [
    ("Owner's", "contract_defined_term:owner"), (" ( Contractors ) ", "contract_defined_term:contractor"), ("Hatco Corporation", "shared_allowlist:hatco"), ("32 13 13", "structural:csi_masterformat_code"),
    ("3 CIR", "structural:panel_circuit_reference"), ("16 inches o.c.", "structural:dimension_callout"), ("see note this sheet for size", "boilerplate:see note this sheet"), ("  ", "empty"), ("City of Panama City", None), ("L2.0", "structural:sheet_number"),
])
def test_reasons(spark, text, reason):
    row = spark.createDataFrame([(text,)], "t string").select(suppress.suppression_reason(F.col("t"), Policy()).alias("r")).first()
    assert row.r == reason


def test_denylist_is_never_ruled_out_and_context_is(spark):
    df = spark.createDataFrame([("denylist", "Owner", "x"), ("street_address", "9 ST", "6\"9 ST"), ("email", "docs@x.org", "docs@x.org, All rights reserved"), ("street_address", "1 Main St", "1 Main St")], "c string, t string, x string")
    out = [r.r for r in df.select(suppress.candidate_suppression(F.col("c"), F.col("t"), Policy(), context=F.col("x")).alias("r")).collect()]
    assert out == [None, "structural:feet_inches_dimension", "boilerplate_context:all rights reserved", None]


@pytest.mark.parametrize("text, why", [
    ("Treat plywood indicated on Drawings.", "prose:function_words"), ("City of Panama City, Florida", None), ("rTlfld ifiefti works", "garbage:internal_case_flip"), ("McDonald Company Works", None), ("© Firm Name", "glyph:©"),
    ("QRX-21109", None), ("a b c d e f g h", "too_many_tokens:8"), ("one_._two words", "garbage:repeated_punctuation"), ("abc", "too_few_alnum_chars"),
])
def test_proposal_rules(spark, text, why):
    assert spark.createDataFrame([(text,)], "t string").select(suppress.proposal_rejection(F.col("t"), Policy()).alias("r")).first().r == why


def test_text_functions(spark):
    row = spark.createDataFrame([("  a \u00a0 b;-", "Ab1é-Ü", "TWO O'CLOCK PLAN", "/x/Harbor-Tower_plans set.pdf")], "a string, b string, c string, p string")
    got = row.select(T.normalized(F.col("a")), T.masked_shape(F.col("b")), T.recase(F.col("c")), T.filename_phrase(F.col("p")), T.keyed_digest(b"k", F.lit("v"))).first()
    import hashlib
    import hmac

    assert tuple(got) == ("a b", "Aa9a-A", "Two O'Clock Plan", "Harbor Tower", hmac.new(b"k", b"v", hashlib.sha256).hexdigest())


def test_redaction_leaves_nothing_and_merges_overlaps(spark, docs):
    engine = Engine(Policy(terms=("QRX-21109", "Bay Holdings")))
    out = engine.redact(docs)
    assert engine.residuals(out).count() == 0
    rows = {r.doc_id: r.text for r in out.collect()}
    assert rows[7] is None and rows[6] == "" and "[EMAIL]" in rows[0] and "[PHONE]" in rows[0] and "@" not in rows[0]
    found = spark.createDataFrame([(1, "a", 0, 2, 5), (1, "b", 1, 4, 8), (1, "c", 2, 10, 11)], "doc_id long, category string, ord int, start int, end int")
    text = spark.createDataFrame([(1, "0123456789abc")], "doc_id long, text string")
    assert redact(text, found).first().text == "01[A]89[C]bc"
    assert redact(text, found, mask="x").first().text == "01xxxxxx89xbc"
    assert {r.release_status for r in engine.report(docs, out).collect()} == {"AUTOMATED_PASS"}
    assert engine.run_status(engine.report(docs, out)).first().status == "REVIEW_REQUIRED"
    assert independent.verify_texts(out, ("QRX-21109",), {"email": V.DIRECT_PATTERNS["email"]}).count() == 0
    assert independent.verify_lines(docs, ("QRX-21109",)).first().spans == 2


def test_independent_verifier_imports_nothing_of_the_engine():
    source = open(independent.__file__).read()
    assert not re.search(r"^\s*(from \.|import veilspark|from veilspark)", source, re.M)


def test_states(spark):
    df = spark.createDataFrame([(False, "complete", 0), (True, None, 0), (True, "open", 0), (True, "complete", 1), (True, "complete", 0)], "a boolean, b string, c int")
    assert [r.s for r in df.select(report.release_status(F.col("a"), F.col("b"), F.col("c")).alias("s")).collect()] == ["FAIL", "REVIEW_REQUIRED", "REVIEW_INCOMPLETE", "REVIEW_INCOMPLETE", "RELEASED"]


def test_zone_note_is_not_carried(spark):
    lines = spark.createDataFrame([(1, 1, 1, "SECTION 00 11 13 - BIDS"), (1, 2, 2, "text"), (1, 3, 3, "SECTION 096500"), (1, 3, 4, "PART 2 - PRODUCTS"), (1, 4, 5, "x"), (2, 1, 1, "none")], "doc_id long, page int, line int, text string")
    assert [r.zone for r in zones.page_zones(lines).orderBy("doc_id", "page").collect()] == ["00/|contracting", "00/|contracting", "09/PRODUCTS|products", "09/PRODUCTS|products", None]


def test_labels_and_proposals(spark):
    rows = [(1, 1, "OWNER:", 0.0, 0.0, 90.0, 12.0), (1, 2, "Harbor Point Holdings LLC", 0.0, 20.0, 90.0, 32.0), (1, 3, "far away value", 0.0, 400.0, 90.0, 412.0), (1, 4, "Architect: Cohen Reynolds Studio", 300.0, 20.0, 500.0, 32.0), (1, 5, "Blue Sky Engineers Group", 300.0, 60.0, 500.0, 72.0)]
    lines = spark.createDataFrame(rows, "doc_id long, ord int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [(r.label, r.value) for r in labels.following_values(lines).collect()] == [("OWNER", "Harbor Point Holdings LLC")]
    terms = {r.term: r.reasons for r in propose.propose_terms(lines, Policy()).collect()}
    assert terms == {"Harbor Point Holdings LLC": ["label_following_line"], "Cohen Reynolds Studio": ["firm_name_pattern", "labelled_value"], "Blue Sky Engineers Group": ["firm_name_pattern"]}


def test_rows_and_model_adapter(spark):
    words = spark.createDataFrame([(1, 1, "a", 0.0, 0.0, 10.0, 10.0), (1, 1, "b", 12.0, 1.0, 10.0, 10.0), (1, 1, "far", 200.0, 0.0, 10.0, 10.0), (1, 1, "low", 0.0, 40.0, 10.0, 10.0)], "doc_id long, page int, text string, x double, y double, w double, h double")
    assert sorted((r.row, r.segment, r.text) for r in layout.cluster_rows(words).collect()) == [(0, 0, "a b"), (0, 1, "far"), (1, 0, "low")]

    def load():
        return lambda texts, names, threshold: [[{"start": m.start(), "end": m.end(), "label": names[0], "score": 0.9} for m in re.finditer("Acme", t)] + [{"start": -1, "end": 3, "label": names[0], "score": 1}] for t in texts]

    docs = spark.createDataFrame([(1, "The Acme works\n" + "x" * 1200 + "\nand Acme again")], "doc_id long, text string")
    found = sorted((r.start, r.end, r.match) for r in ner.find_entities(docs, load, ("organization",)).collect())
    assert found == [(4, 8, "Acme"), (1220, 1224, "Acme")]


def test_row_clusters_against_brute_force(spark):
    rng = random.Random(5)
    words = [(d, p, f"w{d}_{p}_{i}", rng.uniform(0, 900), rng.uniform(0, 300), rng.uniform(5, 60), rng.choice([8.0, 10.0, 24.0])) for d in range(4) for p in (1, 2) for i in range(rng.choice([1, 40, 150]))]
    want = set()
    for key in {w[:2] for w in words}:
        rows = []
        for w in sorted((w for w in words if w[:2] == key), key=lambda w: w[4] + w[6] / 2):
            near = rows and abs(w[4] + w[6] / 2 - fmean(v[4] + v[6] / 2 for v in rows[-1])) <= max(8, 0.6 * w[6])
            rows[-1:] = [[*rows[-1], w]] if near else [*rows[-1:], [w]]
        for k, row in enumerate(rows):
            row.sort(key=lambda w: w[3])
            cuts = [i for i in range(1, len(row)) if row[i][3] - row[i - 1][3] - row[i - 1][5] > max(100, 4 * max(w[6] for w in row))]
            want |= {(*key, k, n, " ".join(w[2] for w in row[i:j])) for n, (i, j) in enumerate(zip([0, *cuts], [*cuts, len(row)], strict=True))}
    df = spark.createDataFrame(words, "doc_id long, page int, text string, x double, y double, w double, h double")
    got = [tuple(r) for r in layout.cluster_rows(df).collect()]
    assert set(got) == want and len(got) == len(want) > 60


def test_row_clusters_cross_batches_and_leave_no_order_open(spark):
    rng = random.Random(9)
    words = [(d, 1, f"w{i}", float(rng.randrange(12) * 70), float(rng.randrange(3) * 30 if d else 5), 30.0, 10.0) for d in range(3) for i in range((300, 90, 1)[d])] + [(None, 1, "a", 0.0, 0.0, 9.0, 9.0), (None, 1, "b", 500.0, 0.0, 9.0, 9.0), (7, None, "c", None, 0.0, 9.0, 9.0), (7, None, None, 1.0, None, 9.0, 9.0)]
    kinds = "doc_id long, page int, text string, x double, y double, w double, h double"
    made = []
    for rows, size in ((words, 10000), (words[::-1], 32), (rng.sample(words, len(words)), 7)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            out = layout.cluster_rows(spark.createDataFrame(rows, kinds))
            made.append(Counter(tuple(r) for r in out.collect()))
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert made[0] == made[1] == made[2]
    rows = {k[:3] for k in made[0]}
    assert {k for k in made[0] if k[0] is None} == {(None, 1, 0, 0, "a"), (None, 1, 0, 1, "b")} and {k for k in made[0] if k[0] == 7} == {(7, None, 0, 0, "c"), (7, None, 1, 0, "")}
    assert {k for k in rows if k[0] == 0} == {(0, 1, 0)} and {k for k in rows if k[0] == 1} == {(1, 1, 0), (1, 1, 1), (1, 1, 2)}
    (text,) = (k[4] for k in made[0] if k[0] == 0)
    assert text.split() == [w[2] for w in sorted((w for w in words if w[0] == 0), key=lambda w: (w[3], w[2]))]
    assert "InPandas" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_every_word_of_the_table_is_clustered(spark):
    sf = "/root/testdata/sf0.001"
    out = queries.QUERIES["ocr_row_cluster"](spark, sf).collect()
    ids = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("(l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey * 7 + l_suppkey AS id").collect()
    assert Counter(t for r in out for t in r.text.split()) == Counter(str(r.id) for r in ids)


def test_evaluation_and_review(spark):
    golden = spark.createDataFrame([("Bay Holdings", "party"), ("Hatco", "manufacturer"), ("3 CIR", "structural"), ("Some Firm Name", "hard_negative")], "term string, verdict string")
    m = evaluate.metrics(evaluate.outcomes(evaluate.classify(golden, Policy(terms=("Bay Holdings",))))).first()
    assert (m.party_redacted, m.party_total, m.survive_redacted, m.noisy_handled, m.noisy_total) == (1, 1, 0, 2, 2)
    rows = [("f", "safe", "n", "h", 1), ("f", "duplicate", "n", "h", 2), ("g", "odd", "n", "h", 3), ("h", "safe", "n", None, 3)]
    last = triage.latest_decisions(spark.createDataFrame(rows, "finding_id string, disposition string, note string, output_sha256 string, decided_at long"))
    assert [(r.finding_id, r.disposition) for r in last.collect()] == [("f", "duplicate")]


def test_kept_matches_stay_whole_where_others_overlap(spark):
    docs = spark.createDataFrame([(1, "call +1 (407) 555-7710 Harbor Ave now"), (2, "mail a.b@c.com or 850-555-0147@x.com"), (3, "none"), (4, None)], "doc_id long, text string")
    engine = Engine(Policy())
    out = engine.redact(docs, keep=("phone",))
    assert {r.doc_id: r.text for r in out.collect()} == {1: "call +1 (407) 555-7710[STREET_ADDRESS] now", 2: "mail [EMAIL] or 850-555-0147[EMAIL]", 3: "none", 4: None}
    assert {(r.doc_id, r.category, r.shape) for r in engine.residuals(out).collect()} == {(1, "phone", "+9 (999) 999-9999"), (2, "phone", "999-999-9999")}
    assert {r.doc_id: (list(r.remediated), r.passed) for r in engine.remediate(out).collect()} == {1: (["phone"], False), 2: (["phone"], False), 3: ([], True), 4: ([], True)}


def test_report_looks_twice_at_each_text_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "aa@example.com and bb@example.com"), (2, "mail copyright@aia.org"), (3, None)], "doc_id long, text string")
    engine = Engine(Policy())
    report = engine.report(docs)
    assert {r.doc_id: (r.redactions, r.suppressed, r.residuals, r.release_status) for r in report.collect()} == {r.doc_id: (r.redactions, r.suppressed, r.residuals, r.release_status) for r in engine.report(docs, engine.redact(docs)).collect()}
    assert {r.doc_id: (r.redactions, r.suppressed) for r in report.collect()}[1] == ({"email": 2, "url": 2}, None)
    assert "Exchange" not in report._jdf.queryExecution().executedPlan().toString()


def test_following_values_and_counts_as_by_brute_force(spark):
    rng, nan = random.Random(5), float("nan")
    texts = ("OWNER:", "Harbor Tower LLC", "Drawn by", "Bay 12", "x", "")
    rows = [(rng.randrange(3), rng.randrange(60) if rng.random() < 0.97 else None, rng.choice(texts), *[rng.choice((0.0, 30.0, 80.0, 300.0)) for _ in range(2)]) for _ in range(240)]
    rows = [(d, o, t, x, None if k % 41 == 0 else y, nan if k % 37 == 0 else x + 60, y + 12) for k, (d, o, t, x, y) in enumerate(rows)]
    lines = spark.createDataFrame(rows, "doc_id long, ord long, text string, x0 double, y0 double, x1 double, y1 double")
    lines.createOrReplaceTempView("brute_lines")
    pairs = """SELECT l.doc_id, l.ord AS a, v.ord AS b, v.text AS value, l.y0 AS ly, v.y0 AS vy FROM brute_lines l JOIN brute_lines v ON l.doc_id = v.doc_id AND v.ord > l.ord WHERE l.text IN ('OWNER:', 'Drawn by') AND v.text IN ('Harbor Tower LLC', 'Bay 12')
        AND NOT EXISTS (SELECT 1 FROM brute_lines s WHERE s.doc_id = l.doc_id AND s.ord > l.ord AND s.ord <= v.ord AND s.y0 - l.y1 > 120)
        AND (abs(v.x0 - l.x0) <= greatest(36D, greatest(1D, l.x1 - l.x0) * 0.5) OR (least(v.x1, l.x1) > greatest(v.x0, l.x0) AND least(v.y1, l.y1) > greatest(v.y0, l.y0)))"""
    want = Counter((r.doc_id, r.a, r.b, r.value) for r in spark.sql(pairs).collect())
    assert len(want) > 50
    assert Counter((r.doc_id, r.label_ord, r.value_ord, r.raw) for r in labels.following_values(lines).collect()) == want
    counted = Counter()
    for r in labels.following_counts(lines).collect():
        counted[r.value] += r.labels
    by_value = Counter()
    for k, n in want.items():
        by_value[k[3]] += n
    assert counted == by_value
    first = {(r.doc_id, r.label_ord): r.value_ord for r in labels.following_values(lines, only_first=True).collect()}
    assert first == {(d, a): min(k[2] for k in want if k[:2] == (d, a)) for d, a, _, _ in want}


def test_pairs_become_rows_outside_python_and_labels_cross_batches(spark):
    rng = random.Random(7)
    rows = [(d, n // 3 if d else n, rng.choice(("OWNER:", "DRAWN BY", f"Bay {n % 9} Tower", f"Note {n}")), rng.choice((0.0, 30.0, 60.0, 200.0)), float(rng.randrange(30) * 10)) for d in range(3) for n in range((500, 400, 20)[d])]
    lines = spark.createDataFrame([(d, o, t, x, y, x + 90, y + 12) for d, o, t, x, y in rows], "doc_id long, ord long, text string, x0 double, y0 double, x1 double, y1 double")
    want, first, counted = Counter(), {}, Counter()
    for k, (d, o, t, x, y) in enumerate(rows):
        later = sorted((r for r in rows if r[0] == d and r[1] > o), key=lambda r: r[1]) if t in ("OWNER:", "DRAWN BY") else ()
        end = next((r[1] for r in later if r[4] - (y + 12) > 120), float("inf"))
        for _, o2, t2, x2, y2 in later:
            if o2 < end and t2 not in ("OWNER:", "DRAWN BY") and (abs(x2 - x) <= 45 or (abs(x2 - x) < 90 and abs(y2 - y) < 12)):
                want[d, o, o2, t.strip(":"), t2] += 1
                counted[t2] += 1
                first[d, o] = min(o2, first.get((d, o), o2))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        every = labels.following_values(lines)
        assert Counter((r.doc_id, r.label_ord, r.value_ord, r.label, r.value) for r in every.collect()) == want and sum(want.values()) > 5000
        got = Counter()
        for r in labels.following_counts(lines).collect():
            got[r.value] += r.labels
        assert got == counted
        assert {(r.doc_id, r.label_ord): r.value_ord for r in labels.following_values(lines, only_first=True).collect()} == first
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Generate explode(pairs" in every._jdf.queryExecution().optimizedPlan().toString()


def test_phrases_are_examined_once_whatever_found_them(spark):
    rows = [(1, 1, "OWNER:", 0.0), (1, 2, "Blue Sky Engineers Group", 20.0), (1, 3, "Architect: Blue Sky Engineers Group", 40.0), (1, 4, "Blue Sky Engineers Group", 60.0)]
    lines = spark.createDataFrame(rows, "doc_id long, ord int, text string, y0 double").selectExpr("*", "0D x0", "90D x1", "y0 + 12 AS y1")
    out = propose.propose_terms(lines, Policy())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in out.collect()] == [("Blue Sky Engineers Group", 7, ["firm_name_pattern", "label_following_line", "labelled_value"])]
    assert "collect_set" not in plan and "bit_or" in plan
    names = ["Hatco", "Hatco Corporation", "hatco, Inc., LLC", "(Hatco) ", "Hatcorp", "Hat co", "", None, ", Hatco", "3M Company", "3M,Co.", "Products", "Bay Co Hatco", "American Concrete Institute, Inc"]
    keys = Policy().allowed
    both = spark.createDataFrame([(n,) for n in names], "n string").select(T.allow_key(F.col("n")).alias("a"), T.allow_key(F.col("n"), sought=keys).alias("b")).collect()
    assert [r.a in keys for r in both] == [r.b in keys for r in both] and sum(r.b in keys for r in both) >= 4 and sum(r.b is None for r in both) >= 4


def test_items_over_redacted_come_once_and_images_meet_without_pairs(spark):
    from veilspark.operators import spatial

    box = "rect struct<x0:double,y0:double,x1:double,y1:double>"
    items = spark.createDataFrame([(1, 7, 0, "contact"), (1, 7, 0, "contact"), (1, 8, 1, "contact")], "doc_id long, item_id long, page int, category string")
    pages = spark.createDataFrame([(1, 1, ["email", "denylist"])], "doc_id long, page int, categories array<string>")
    assert [tuple(r) for r in evaluate.over_redacted(items, pages).collect()] == [(1, 7)]
    marks = spark.createDataFrame([(1, 1, 5, (0.0, 0.0, 1.0, 1.0)), (1, 2, 6, (0.0, 0.0, 1.0, 1.0))], f"doc_id long, page int, label_id long, {box}")
    images = spark.createDataFrame([(1, 1, 3, (2.0, 0.0, 3.0, 1.0)), (1, 1, 2, (2.0, 0.0, 3.0, 1.0)), (1, 1, 1, (5.0, 0.0, 6.0, 1.0)), (1, 2, 4, (0.0, 0.0, 99.0, 99.0))], f"doc_id long, page int, image_id long, {box}")
    whole = spark.createDataFrame([(1, 1, (0.0, 0.0, 10.0, 10.0)), (1, 2, (0.0, 0.0, 10.0, 10.0))], f"doc_id long, page int, {box}")
    near = spatial.nearest_images(marks, images, whole)
    assert {r.label_id: tuple(r.rect) for r in near.collect()} == {5: (0.0, 0.0, 3.0, 1.0), 6: (0.0, 0.0, 2.4, 2.4)}
    assert "array_min" in near._jdf.queryExecution().optimizedPlan().toString()  # a label meets its page's images in one row
