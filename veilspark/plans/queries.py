"""One query for each operator, over whole tables, and its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import policy_values as V
from ..functions import rects as R
from ..functions import text as T
from ..operators import detections, evaluate, labels, layout, propose, report, runs, scan, spatial, suppress, triage, zones
from ..operators.redact import redact
from ..policy import _FOLD_FROM, _FOLD_TO, Policy, fold
from ..verify import independent
from .engine import Engine
from .views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores where a small input has fewer splits than there are cores; larger inputs aren't moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(map(quoted, values))


TERMS = ("QRX-21109", "Bay Holdings")
POLICY = Policy(terms=TERMS)

# -- pattern scans ---------------------------------------------------------------------------

_INPUTS = {"file_path": "v_path", "email": "v_mail", "url": "v_url", "phone": "v_phone", "po_box": "v_pobox", "street_address": "v_addr", "city_state_zip": "v_csz", "coordinate": "v_coord", "parcel_or_lot": "v_parcel", "permit_or_application": "v_permit", "project_or_job_number": "v_project", "credentialed_person": "v_cred"}
# RE2 has no lookaround: the guards are groups of their own and the match is group 2
_GUARDED = {
    "phone": r"(?i)(^|[^0-9])((?:\+?1[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]\d{3}[ .-]\d{4}(?:\s*(?:x|ext\.?|extension)\s*\d+)?)([^0-9]|$)",
    "coordinate": r"(?i)(^|[^0-9])([+-]?\d{1,3}\.\d{4,}\s*[,;/]\s*[+-]?\d{1,3}\.\d{4,})([^0-9]|$)",
}


def _scan_query(category: str, source: str):
    def run(spark, sf_dir):
        found = scan.scan(view(spark, sf_dir, source), categories=(category,))
        return found.groupBy("id").agg(F.count("*").alias("matches"), F.min_by("match", "start").alias("first_match"))

    p, g = (_GUARDED[category], 2) if category in _GUARDED else (V.DIRECT_PATTERNS[category], 0)
    sql = with_views(source) + f"SELECT id, len(m)::BIGINT AS matches, m[1] AS first_match FROM (SELECT id, regexp_extract_all(text, {quoted(p)}, {g}) AS m FROM {source}) WHERE len(m) > 0"
    add(f"scan_{category}", run, sql)


for _category, _source in _INPUTS.items():
    _scan_query(_category, _source)


def _count_by_category(spark, sf_dir):
    return scan.count_by_category(spread(table(spark, sf_dir, "documents").select("text")))


_union = " UNION ALL ".join(f"SELECT {quoted(c)} AS category, doc_id, len(regexp_extract_all(text, {quoted(_GUARDED.get(c, p))}, {2 if c in _GUARDED else 0})) AS n FROM documents" for c, p in V.DIRECT_PATTERNS.items())
add("count_by_category", _count_by_category, f"SELECT category, sum(n)::BIGINT AS matches, count(CASE WHEN n > 0 THEN 1 END) AS documents FROM ({_union}) GROUP BY category")

_email = V.DIRECT_PATTERNS["email"]
add(
    "scan_offsets",
    lambda spark, d: scan.scan(table(spark, d, "documents").select("doc_id", "text"), categories=("email",)).select("doc_id", "start", "end", "match"),
    f"""WITH p AS (SELECT doc_id, string_split_regex(regexp_replace(text, {quoted('(' + _email + ')')}, chr(1) || '\\1' || chr(2), 'g'), '[' || chr(1) || chr(2) || ']') AS s FROM documents),
        k AS (SELECT doc_id, unnest(s) AS piece, unnest(range(1, len(s) + 1)) AS i FROM p),
        o AS (SELECT doc_id, piece, i, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM k)
        SELECT doc_id, (e - length(piece))::INT AS start, e::INT AS "end", piece AS match FROM o WHERE i % 2 = 0""",
)
add(
    "scan_pages_url",
    lambda spark, d: scan.scan(table(spark, d, "pages").select("page_id", F.col("html").alias("text")), categories=("url",)).groupBy("page_id").agg(F.count("*").alias("matches")),
    f"SELECT page_id, len(m)::BIGINT AS matches FROM (SELECT page_id, regexp_extract_all(html, {quoted(V.DIRECT_PATTERNS['url'])}) AS m FROM pages) WHERE len(m) > 0",
)
add(
    "denylist_scan",
    lambda spark, d: scan.scan(view(spark, d, "v_deny"), categories=("denylist",), policy=POLICY).groupBy("id").agg(F.count("*").alias("matches"), F.min("match").alias("first_match")),
    with_views("v_deny") + r"SELECT id, len(m)::BIGINT AS matches, m[1] AS first_match FROM (SELECT id, regexp_extract_all(text, '(?i)(^|[^A-Z0-9])(QRX[\s\-‐‑‒–—―−]*21109)([^A-Z0-9]|$)', 2) AS m FROM v_deny) WHERE len(m) > 0",
)

# -- labels ----------------------------------------------------------------------------------

_LV = rf"(?i)^\s*(?:{V.LABEL_NAME})\s*[:|-]\s*(.+)$"
_L = rf"(?i)^\s*(?:{V.LABEL_NAME})\s*(?::|-)?\s*$"
add(
    "label_value",
    lambda spark, d: view(spark, d, "v_label").select("id", labels.label_value(F.col("text")).alias("value"), labels.is_label(F.col("text")).alias("label_alone")),
    with_views("v_label") + f"SELECT id, CASE WHEN regexp_matches(text, {quoted(_LV)}) THEN regexp_extract(text, {quoted(_LV)}, 1) END AS value, regexp_matches(text, {quoted(_L)}) AS label_alone FROM v_label",
)
_norm = r"trim(regexp_replace({x}, '\s+', ' ', 'g'), ' ' || chr(9) || ':;,-')"


def _redactable_sql(x: str, short: bool) -> str:
    n = f"({_norm.format(x=x)})"
    t = f"regexp_extract_all({n}, '[A-Za-z0-9]+')"
    return f"(length({n}) BETWEEN {2 if short else 4} AND 180 AND len({t}) > 0" + ("" if short else f" AND (len({t}) <> 1 OR length({t}[1]) >= 7)") + f" AND regexp_matches({n}, '{'[a-zA-ZÀ-ÿ0-9]' if short else '[a-zA-ZÀ-ÿ]'}'))"


def _values_sql(source: str, reach: int) -> str:
    """Pairs of a lone label and its values: all later lines of the page in order, up to the first that is too far down."""
    return rf"""n AS (SELECT *, {_norm.format(x='text')} AS t FROM {source}),
    p AS (SELECT l.doc_id, l.ord AS label_ord, v.ord AS value_ord, l.t AS label, v.t AS value, v.text AS raw, v.x0, v.y0, l.x0 AS lx0, l.x1 AS lx1, l.y0 AS ly0, l.y1 AS ly1, v.x1, v.y1, max(v.y0) OVER (PARTITION BY l.doc_id, l.ord ORDER BY v.ord) AS deepest
        FROM n l JOIN n v ON l.doc_id = v.doc_id AND v.ord > l.ord WHERE regexp_matches(l.t, {quoted(_L)})),
    w AS (SELECT * FROM p WHERE deepest - ly1 <= {reach} AND {_redactable_sql('value', True)} AND len(string_split_regex(value, '\s+')) <= 10 AND NOT regexp_matches(value, {quoted(_L)})
        AND (abs(x0 - lx0) <= greatest(36.0, greatest(1.0, lx1 - lx0) * 0.5) OR (least(x1, lx1) > greatest(x0, lx0) AND least(y1, ly1) > greatest(y0, ly0))))"""


_pair = ("doc_id", "label_ord", "value_ord", "label", "value")
add("label_following", lambda spark, d: labels.following_values(view(spark, d, "v_page")).select(*_pair), with_views("v_page") + f", {_values_sql('v_page', 120)} SELECT {', '.join(_pair)} FROM w")
add(
    "label_first_value",
    lambda spark, d: labels.following_values(view(spark, d, "v_page"), reach=72.0, only_first=True).select(*_pair),
    with_views("v_page") + f", {_values_sql('v_page', 72)} SELECT {', '.join(_pair)} FROM w QUALIFY row_number() OVER (PARTITION BY doc_id, label_ord ORDER BY value_ord) = 1",
)
add(
    "proposed_terms",
    lambda spark, d: propose.propose_terms(view(spark, d, "v_page"), POLICY),
)

# -- scalar functions --------------------------------------------------------------------------

add("normalize_text", lambda spark, d: view(spark, d, "v_short").select("id", T.normalized(F.col("text")).alias("value")), with_views("v_short") + f"SELECT id, {_norm.format(x='text')} AS value FROM v_short")
add(
    "masked_shape",
    lambda spark, d: table(spark, d, "documents").select("doc_id", T.masked_shape(F.col("text")).alias("shape")),
    r"""SELECT doc_id, CASE WHEN length(s) <= 80 THEN s ELSE left(s, 80) || '…' END AS shape FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\p{Lu}', 'A', 'g'), '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}B-Z]', 'a', 'g'), '\p{Nd}', '9', 'g') AS s FROM documents)""",
)
add(
    "redactable",
    lambda spark, d: view(spark, d, "v_short").select("id", T.redactable(F.col("text")).alias("strict"), T.redactable(F.col("text"), True).alias("loose")),
    with_views("v_short") + f"SELECT id, {_redactable_sql('text', False)} AS strict, {_redactable_sql('text', True)} AS loose FROM v_short",
)
_fold_sql = f"lower(translate({{x}}, {quoted(_FOLD_FROM)}, {quoted(_FOLD_TO)}))"
_collapse = r"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _defined_sql(x: str) -> str:
    key = _fold_sql.format(x=f"trim(trim({_collapse.format(x=x)}, {quoted(V.DEFINED_STRIP)}))")
    cases = " ".join(f"WHEN ends_with({key}, {quoted(a)}) AND length({key}) > {len(a) + 1} THEN trim(trim(left({key}, length({key}) - {len(a)}), ' ''\"-'))" for a in (fold(a) for a in V.DEFINED_AFFIXES))
    return f"(CASE {cases} ELSE {key} END)"


def _allow_sql(x: str) -> str:
    import re

    key = f"trim(trim({_collapse.format(x=x)}, {quoted(V.ALLOW_STRIP)}))"
    for s in V.COMPANY_SUFFIXES:
        key = f"trim(regexp_replace({key}, {quoted(f'(?i)[,{chr(92)}s]+{re.escape(s)}{chr(92)}.?$')}, ''))"
    return _fold_sql.format(x=key)


add(
    "defined_and_allow_keys",
    lambda spark, d: view(spark, d, "v_short").select("id", T.defined_key(F.trim(T.collapse(F.col("text")))).alias("defined"), T.allow_key(F.trim(T.collapse(F.col("text")))).alias("allowed")),
    with_views("v_short") + f"SELECT id, {_defined_sql('text')} AS defined, {_allow_sql('text')} AS allowed FROM v_short",
)


def _phrase_sql(folded: str, phrases) -> str:
    return f"(list_filter([{listed(phrases)}], lambda p: contains({folded}, p)))[1]"


_BARE = suppress._BARE
_structural_sql = "CASE " + " ".join(f"WHEN regexp_full_match(x, {quoted('(?i)' + p)}) OR (b <> '' AND regexp_full_match(b, {quoted('(?i)' + p)})) THEN {quoted(n)}" for n, p in V.STRUCTURAL) + " END"
add(
    "suppression_reason",
    lambda spark, d: view(spark, d, "v_short").select("id", suppress.suppression_reason(F.col("text"), POLICY).alias("reason")),
    with_views("v_short")
    + f""", k AS (SELECT id, {_collapse.format(x='text')} AS x, trim({_collapse.format(x='text')}, {quoted(_BARE)}) AS b, {_defined_sql('text')} AS d, {_allow_sql('text')} AS a FROM v_short)
    SELECT id, coalesce(CASE WHEN x = '' THEN 'empty' END, CASE WHEN d IN ({listed(sorted(POLICY.defined))}) THEN 'contract_defined_term:' || d END,
        CASE WHEN a IN ({listed(sorted(POLICY.allowed))}) THEN 'shared_allowlist:' || a END, 'structural:' || ({_structural_sql}), 'boilerplate:' || {_phrase_sql(_fold_sql.format(x='x'), POLICY.boilerplate)}) AS reason FROM k""",
)
add(
    "boilerplate_context",
    lambda spark, d: view(spark, d, "v_short").select("id", suppress.boilerplate_context(F.concat(F.lit("Sheet 3: "), "text", F.lit(" (typical unless noted)")), POLICY).alias("phrase")),
    with_views("v_short") + f"SELECT id, {_phrase_sql(_fold_sql.format(x=_collapse.format(x='concat(' + quoted('Sheet 3: ') + ', text, ' + quoted(' (typical unless noted)') + ')')), POLICY.boilerplate)} AS phrase FROM v_short",
)
_product_text = "'Basis of Design: ' || rpad('', 200, '. ') || text"
add(
    "manufacturer_evidence",
    lambda spark, d: view(spark, d, "v_addr").withColumn("at", F.expr("cast(20 + id % 180 AS int)")).select("id", suppress.product_evidence(F.expr(_product_text), F.col("at"), F.col("at") + 5, POLICY).alias("evidence")),
    with_views("v_addr") + f"SELECT id, {_phrase_sql(_fold_sql.format(x='substr(x, greatest(0, spot - 120) + 1, spot + 125 - greatest(0, spot - 120))'), POLICY.products)} AS evidence FROM (SELECT id, 20 + id % 180 AS spot, {_product_text} AS x FROM v_addr)",
)
add("shape_rejection", lambda spark, d: view(spark, d, "v_short").select("id", suppress.proposal_rejection(F.concat("text", F.lit(" of the Harbor")), POLICY).alias("why")))
_KEY = hashlib.sha256(b"a fixed test key").digest()
_pads = ["".join(f"{b ^ p:02x}" for b in _KEY.ljust(64, b"\0")) for p in (0x36, 0x5C)]
add(
    "keyed_digest",
    lambda spark, d: table(spark, d, "customer").select("c_custkey", T.keyed_digest(_KEY, F.col("c_name")).alias("digest")),
    f"SELECT c_custkey, sha256(from_hex('{_pads[1]}') || from_hex(sha256(from_hex('{_pads[0]}') || encode(c_name)))) AS digest FROM customer",
)
add("derive_doc_id", lambda spark, d: table(spark, d, "pages").select("page_id", T.doc_id_of(F.col("url")).alias("name")), "SELECT page_id, trim(regexp_replace(url, '[^A-Za-z0-9_-]+', '_', 'g'), '_') AS name FROM pages")
add("plain_guess", lambda spark, d: view(spark, d, "v_box").groupBy(triage.plain_guess(F.col("category")).alias("guess")).agg(F.count("*").alias("n")), with_views("v_box") + f"SELECT CASE category {' '.join(f'WHEN {quoted(k)} THEN {quoted(v)}' for k, v in triage.PLAIN_GUESS.items())} ELSE 'flagged item' END AS guess, count(*) AS n FROM v_box GROUP BY 1")
_digest_line = "coalesce(list_extract(string_split(left(text, {s}), chr(10)), -1), '') || substr(text, {s} + 1, 5) || coalesce(list_extract(string_split(substr(text, {s} + 6), chr(10)), 1), '')"
add("containing_line", lambda spark, d: table(spark, d, "documents").select("doc_id", T.containing_line(F.col("text"), F.lit(40), F.lit(45)).alias("line")), f"SELECT doc_id, {_digest_line.format(s=40)} AS line FROM documents")

# -- layout ------------------------------------------------------------------------------------

add(
    "lines",
    lambda spark, d: layout.text_lines(table(spark, d, "documents")).select("doc_id", "line", F.length("text").alias("chars"), "y0", "y1"),
    r"SELECT doc_id, i AS line, length(t) AS chars, (i * 20)::DOUBLE AS y0, (i * 20 + 12)::DOUBLE AS y1 FROM (SELECT doc_id, unnest(s) AS t, unnest(range(0, len(s)))::INT AS i FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e]') AS s FROM documents)) WHERE trim(t) <> ''",
)
add(
    "block_offsets",
    lambda spark, d: layout.with_offsets(view(spark, d, "v_page").select("doc_id", F.col("ord").alias("line"), "text"), ("doc_id",), ("line",)).select("doc_id", "line", "start", "end"),
    with_views("v_page") + 'SELECT doc_id, ord AS line, coalesce(sum(length(text) + 1) OVER w, 0)::BIGINT AS start, (coalesce(sum(length(text) + 1) OVER w, 0) + length(text))::BIGINT AS "end" FROM v_page WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)',
)
add(
    "page_text",
    lambda spark, d: layout.joined_text(view(spark, d, "v_spec"), ("doc_id", "page"), ("line",)).select("doc_id", "page", F.sha2("text", 256).alias("digest")),
    with_views("v_spec") + "SELECT doc_id, page, sha256(string_agg(text, chr(10) ORDER BY line)) AS digest FROM v_spec GROUP BY 1, 2",
)
add(
    "page_kind",
    lambda spark, d: layout.page_kind(view(spark, d, "v_box").select("id", (F.col("id") % 60).alias("chars"), (F.col("x0") / 1000).alias("ratio"))).groupBy("page_kind", "needs_raster").agg(F.count("*").alias("n")),
    with_views("v_box") + "SELECT CASE WHEN id % 60 >= 20 AND x0 / 1000 >= 0.02 THEN 'mixed' WHEN id % 60 >= 20 THEN 'searchable' ELSE 'raster' END AS page_kind, (id % 60 < 20 OR x0 / 1000 >= 0.02) AS needs_raster, count(*) AS n FROM v_box GROUP BY 1, 2",
)
add("ocr_row_cluster", lambda spark, d: layout.cluster_rows(view(spark, d, "v_word")))
add(
    "zone_carry",
    lambda spark, d: zones.page_zones(view(spark, d, "v_spec")),
    with_views("v_spec")
    + f"""
    , h AS (SELECT doc_id, page, line, CASE WHEN regexp_matches(text, {quoted('(?i)' + V.SECTION_HEADER)}) THEN left(regexp_replace(regexp_extract(text, {quoted('(?i)' + V.SECTION_HEADER)}, 1), '\\D', '', 'g'), 2) END AS dv,
        CASE WHEN regexp_matches(text, {quoted('(?i)' + V.PART_HEADER)}) THEN upper(regexp_extract(text, {quoted('(?i)' + V.PART_HEADER)}, 2)) END AS pt FROM v_spec),
    s AS (SELECT *, count(dv) OVER w AS g, last_value(dv IGNORE NULLS) OVER w AS cd FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY page, line)),
    z AS (SELECT *, last_value(pt IGNORE NULLS) OVER (PARTITION BY doc_id, g ORDER BY page, line) AS cp FROM s),
    e AS (SELECT doc_id, page, coalesce(arg_max(coalesce(cd, ''), line), '') AS d, coalesce(arg_max(coalesce(cp, ''), line), '') AS p FROM z GROUP BY 1, 2)
    SELECT doc_id, page, CASE WHEN d <> '' OR p <> '' THEN d || '/' || p || CASE WHEN d IN ({listed(V.PARTY_DIVISIONS)}) THEN '|contracting' WHEN p = 'PRODUCTS' THEN '|products' ELSE '' END END AS zone FROM e""",
)

# -- rectangles --------------------------------------------------------------------------------

def _boxes(spark, d):
    return view(spark, d, "v_box").withColumn("rect", F.struct("x0", "y0", "x1", "y1"))


add(
    "halfpoint_dedupe",
    lambda spark, d: spatial.dedupe_half_points(_boxes(spark, d), order="id").groupBy("doc_id", "category").agg(F.count("*").alias("n"), F.min("id").alias("first_id")),
    with_views("v_box") + "SELECT doc_id, category, count(*) AS n, min(id) AS first_id FROM (SELECT * FROM v_box WHERE x1 > x0 AND y1 > y0 QUALIFY row_number() OVER (PARTITION BY doc_id, page, round_even(x0 * 2, 0), round_even(y0 * 2, 0), round_even(x1 * 2, 0), round_even(y1 * 2, 0) ORDER BY id) = 1) GROUP BY 1, 2",
)


def _cell_query(spark, d):
    cells = table(spark, d, "part").selectExpr("p_partkey % 50 AS doc_id", "p_size % 7 + 1 AS page", "p_partkey AS cell_id", "struct(cast(p_size AS double) AS x0, cast((p_size % 7 + 1) * 20 AS double) AS y0, cast(p_size + 4 AS double) AS x1, cast((p_size % 7 + 1) * 20 + 6 AS double) AS y1) AS rect")
    return spatial.cells_crossed(_boxes(spark, d).withColumnRenamed("id", "match_id"), cells)


add(
    "cell_crossings",
    _cell_query,
    with_views("v_box")
    + f""", c AS (SELECT p_partkey % 50 AS doc_id, p_size % 7 + 1 AS page, p_partkey AS cell_id, p_size::DOUBLE AS x0, ((p_size % 7 + 1) * 20)::DOUBLE AS y0, (p_size + 4)::DOUBLE AS x1, ((p_size % 7 + 1) * 20 + 6)::DOUBLE AS y1 FROM part)
    SELECT b.id AS match_id, count(DISTINCT c.cell_id) AS cells FROM v_box b LEFT JOIN c ON b.category IN ({listed(V.TABLE_FRAGILE)}) AND b.doc_id = c.doc_id AND b.page = c.page AND least(b.x1, c.x1) - greatest(b.x0, c.x0) > 1 AND least(b.y1, c.y1) - greatest(b.y0, c.y0) > 1 GROUP BY b.id""",
)


def _region_query(spark, d):
    pages = view(spark, d, "v_box").select("doc_id", "page").distinct().withColumns({"width": F.lit(612.0), "height": F.lit(792.0)})
    regions = spark.createDataFrame([("stamp", "seal", (0.5, 0.0, 1.0, 0.25), True, []), ("title", "title_block", (0.75, 0.75, 1.0, 1.0), False, [1, 3])], "name string, category string, rect struct<x0:double,y0:double,x1:double,y1:double>, all_pages boolean, pages array<int>")
    return spatial.region_rects(pages, regions).select("doc_id", "page", "name", "rect.x0", "rect.y0", "rect.x1", "rect.y1")


add(
    "region_join",
    _region_query,
    with_views("v_box") + ", r AS (SELECT * FROM (VALUES ('stamp', 0.5::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.25::DOUBLE, true, []), ('title', 0.75, 0.75, 1.0, 1.0, false, [1, 3])) t(name, a, b, c, e, everywhere, pages)) SELECT doc_id, page, name, a * 612 AS x0, b * 792 AS y0, c * 612 AS x1, e * 792 AS y1 FROM (SELECT DISTINCT doc_id, page FROM v_box) p JOIN r ON everywhere OR list_contains(pages, page)",
)


def _nearest_query(spark, d):
    boxes = _boxes(spark, d)
    marks = boxes.where("category = 'email'").select("doc_id", "page", F.col("id").alias("label_id"), "rect")
    images = boxes.where("category <> 'email'").select("doc_id", "page", F.col("id").alias("image_id"), "rect")
    pages = boxes.select("doc_id", "page").distinct().withColumn("rect", R.rect(F.lit(0), F.lit(0), F.lit(60), F.lit(160)))
    return spatial.nearest_images(marks, images, pages).select("doc_id", "page", "label_id", "rect.x0", "rect.y0", "rect.x1", "rect.y1")


add(
    "nearest_image",
    _nearest_query,
    with_views("v_box")
    + """, l AS (SELECT * FROM v_box WHERE category = 'email'), i AS (SELECT * FROM v_box WHERE category <> 'email'),
    u AS (SELECT l.doc_id, l.page, l.id AS label_id, i.id AS image_id, l.x0 AS lx0, l.y0 AS ly0, l.x1 AS lx1, l.y1 AS ly1, least(l.x0, i.x0) AS x0, least(l.y0, i.y0) AS y0, greatest(l.x1, i.x1) AS x1, greatest(l.y1, i.y1) AS y1 FROM l LEFT JOIN i ON l.doc_id = i.doc_id AND l.page = i.page),
    k AS (SELECT *, CASE WHEN image_id IS NOT NULL AND (x1 - x0) * (y1 - y0) <= 60 * 160 * 0.45 THEN (x1 - x0) * (y1 - y0) END AS a FROM u),
    f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, page, label_id ORDER BY a NULLS LAST, image_id) = 1)
    SELECT doc_id, page, label_id, CASE WHEN a IS NOT NULL THEN x0 ELSE greatest((lx0 + lx1) / 2 - 60 * 0.19, 0) END AS x0, CASE WHEN a IS NOT NULL THEN y0 ELSE greatest((ly0 + ly1) / 2 - 160 * 0.19, 0) END AS y0,
        CASE WHEN a IS NOT NULL THEN x1 ELSE least((lx0 + lx1) / 2 + 60 * 0.19, 60) END AS x1, CASE WHEN a IS NOT NULL THEN y1 ELSE least((ly0 + ly1) / 2 + 160 * 0.19, 160) END AS y1 FROM f""",
)
add(
    "repeated_images",
    lambda spark, d: spatial.repeated_images(table(spark, d, "lineitem").selectExpr("l_partkey % 97 AS doc_id", "l_suppkey AS image_id", "l_linenumber AS page")),
    "SELECT l_partkey % 97 AS doc_id, l_suppkey AS image_id, count(DISTINCT l_linenumber) AS pages FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_linenumber) >= 3",
)


def _items(spark, d):
    boxes = _boxes(spark, d)
    items = boxes.where("id % 5 = 0").select("doc_id", F.col("id").alias("item_id"), (F.col("page") - 1).alias("page"), "rect", F.expr("CASE id % 3 WHEN 0 THEN 'contact' WHEN 1 THEN 'address' ELSE 'person' END").alias("category"))
    found = boxes.where("id % 5 <> 0").select("doc_id", "page", F.expr("cast(category = 'person name' AS int)").alias("surface"), F.col("id").alias("ord"), "rect", "category")
    return items, found


_items_sql = (
    with_views("v_box")
    + """, i AS (SELECT *, CASE id % 3 WHEN 0 THEN 'contact' WHEN 1 THEN 'address' ELSE 'person' END AS label FROM v_box WHERE id % 5 = 0), f AS (SELECT * FROM v_box WHERE id % 5 <> 0),
    x AS (SELECT i.doc_id, i.id AS item_id, f.id AS ord, (f.category = 'person name')::INT AS surface, f.category AS found_category, greatest(0, least(i.x1, f.x1) - greatest(i.x0, f.x0)) * greatest(0, least(i.y1, f.y1) - greatest(i.y0, f.y0)) AS inner_area,
        (i.x1 - i.x0) * (i.y1 - i.y0) + (f.x1 - f.x0) * (f.y1 - f.y0) AS both_areas, i.label FROM i JOIN f ON i.doc_id = f.doc_id AND i.page = f.page),
    m AS (SELECT doc_id, item_id, surface, ord, found_category FROM x WHERE inner_area > 0 AND inner_area / (both_areas - inner_area) >= 0.3
        AND ((found_category = 'email' AND label = 'contact') OR (found_category = 'street_address' AND label = 'address') OR found_category = 'denylist' OR (found_category = 'person name' AND label = 'person'))
        QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY surface, ord) = 1) """
)
add("iou_match", lambda spark, d: evaluate.match_items(*_items(spark, d)), _items_sql + "SELECT * FROM m")
add("leak_semi", lambda spark, d: evaluate.missed(_items(spark, d)[0], evaluate.match_items(*_items(spark, d))).select("doc_id", "item_id"), _items_sql + "SELECT doc_id, id AS item_id FROM i SEMI JOIN m ON i.doc_id = m.doc_id AND i.id = m.item_id")
add("hit_anti", lambda spark, d: evaluate.hit(_items(spark, d)[0], evaluate.match_items(*_items(spark, d))).select("doc_id", "item_id"), _items_sql + "SELECT doc_id, id AS item_id FROM i ANTI JOIN m ON i.doc_id = m.doc_id AND i.id = m.item_id")
add(
    "over_redaction",
    lambda spark, d: evaluate.over_redacted(_items(spark, d)[0], report.page_categories(_items(spark, d)[1])).select("doc_id", "item_id"),
    _items_sql + "SELECT DISTINCT i.doc_id, i.id AS item_id FROM i JOIN f ON i.doc_id = f.doc_id AND i.page = f.page AND ((f.category = 'email' AND label = 'contact') OR (f.category = 'street_address' AND label = 'address') OR f.category = 'denylist' OR (f.category = 'person name' AND label = 'person'))",
)

# -- counts, caps and states -------------------------------------------------------------------

def _reasons(spark, d):
    texts = suppress.distinct_rows(view(spark, d, "v_short"), "text")
    return texts.select(suppress.suppression_reason(F.col("text"), POLICY).alias("rule"), "n").where("rule is not null")


add("count_by_rule", lambda spark, d: report.rule_counts(_reasons(spark, d)), "SELECT split_part(reason, ':', 1) AS rule, count(*) AS n FROM (" + ORACLES["suppression_reason"] + ") WHERE reason IS NOT NULL GROUP BY 1")
add("page_categories", lambda spark, d: report.page_categories(view(spark, d, "v_box")).select("doc_id", "page", F.array_join("categories", ",").alias("categories")), with_views("v_box") + "SELECT doc_id, page, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM v_box GROUP BY 1, 2")
add("sorted_counters", lambda spark, d: report.sorted_counts(view(spark, d, "v_box"), ["doc_id"], "category").select("doc_id", F.to_json("counts").alias("counts")), with_views("v_box") + """SELECT doc_id, '{' || string_agg('"' || category || '":' || n, ',' ORDER BY category) || '}' AS counts FROM (SELECT doc_id, category, count(*) AS n FROM v_box GROUP BY 1, 2) GROUP BY 1""")
add("residual_cap", lambda spark, d: report.residual_cap(view(spark, d, "v_box"), order="id"), with_views("v_box") + "SELECT doc_id, least(count(*), 200) AS kept, greatest(count(*) - 200, 0) AS truncated FROM v_box GROUP BY 1")


def _findings(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_suppkey % 20 AS doc_id", "l_returnflag AS label", "cast(l_partkey AS string) AS form", "l_linenumber AS page", "l_discount AS score", "l_orderkey * 8 + l_linenumber AS ord", "l_partkey % 30 AS start", "l_partkey % 30 + 5 AS end")


_forms_sql = "WITH f AS (SELECT l_suppkey % 20 AS doc_id, l_returnflag AS label, l_partkey::VARCHAR AS form, l_linenumber AS page, l_discount AS score, l_orderkey * 8 + l_linenumber AS ord, l_partkey % 30 AS s FROM lineitem) "
add(
    "label_cap",
    lambda spark, d: report.form_records(_findings(spark, d), {"A": 20, "_default": 50}).select("doc_id", "label", "form", "occurrences", F.array_join("pages", ",").alias("pages"), "score_max", "listed"),
    _forms_sql + "SELECT doc_id, label, form, count(*) AS occurrences, array_to_string(list_sort(list(DISTINCT page))[1:5], ',') AS pages, max(score) AS score_max, row_number() OVER (PARTITION BY doc_id, label ORDER BY min(ord)) <= CASE label WHEN 'A' THEN 20 ELSE 50 END AS listed FROM f GROUP BY 1, 2, 3",
)
add("best_span", lambda spark, d: report.best_span(_findings(spark, d)).select("doc_id", F.col("start").alias("s"), "label", "score", "ord"), _forms_sql + "SELECT doc_id, s, label, score, ord FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, s ORDER BY score DESC, ord) = 1")
add("profile_by_page_type", lambda spark, d: report.page_profile(table(spark, d, "events").selectExpr("event_type AS page_kind", "event_id % 100 AS seconds", "user_id AS rss")), "SELECT event_type AS page_kind, count(*) AS pages, sum(event_id % 100)::BIGINT AS seconds, max(user_id) AS rss FROM events GROUP BY 1")
add(
    "release_status",
    lambda spark, d: table(spark, d, "orders").select("o_orderkey", report.release_status(F.col("o_orderkey") % 5 != 0, F.expr("CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'complete' ELSE 'incomplete' END"), F.col("o_orderkey") % 2).alias("status")),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'FAIL' WHEN o_orderkey % 3 = 0 THEN 'REVIEW_REQUIRED' WHEN o_orderkey % 3 = 2 THEN 'REVIEW_INCOMPLETE' WHEN o_orderkey % 2 > 0 THEN 'REVIEW_INCOMPLETE' ELSE 'RELEASED' END AS status FROM orders",
)
add("incompleteness", lambda spark, d: report.incompleteness(table(spark, d, "customer").selectExpr("c_custkey AS doc_id", "c_custkey % 3 AS residuals_truncated", "c_custkey % 2 AS findings_truncated")).select("doc_id", F.array_join("reasons", "|").alias("reasons")), "SELECT c_custkey AS doc_id, concat_ws('|', CASE WHEN c_custkey % 3 > 0 THEN c_custkey || ': residual findings truncated' END, CASE WHEN c_custkey % 2 > 0 THEN c_custkey || ': NER review findings truncated' END) AS reasons FROM customer")
add("intake_missing", lambda spark, d: report.missing_fields(table(spark, d, "nation").selectExpr("n_name AS field"), table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("n_name AS field", "if(c_custkey % 200 = 7, 'x', ' ') AS value")), "SELECT n_name AS field FROM nation WHERE n_name NOT IN (SELECT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 200 = 7)")
add("unlabeled_anti", lambda spark, d: table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id"), "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
add("retention", lambda spark, d: report.prune_candidates(table(spark, d, "orders").selectExpr("concat(if(o_orderkey % 4 = 0, '.', ''), 'run-', o_orderkey) AS name", "o_orderdate AS modified"), F.expr("timestamp '1996-01-01 00:00:00'"), 30).select("name"), "SELECT concat(CASE WHEN o_orderkey % 4 = 0 THEN '.' ELSE '' END, 'run-', o_orderkey) AS name FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' - INTERVAL 30 DAYS AND o_orderkey % 4 <> 0")
add("staleness", lambda spark, d: report.stale(table(spark, d, "part").selectExpr("p_partkey AS name", "p_brand AS hash"), table(spark, d, "part").where("p_partkey % 3 > 0").selectExpr("p_partkey AS name", "if(p_partkey % 5 = 0, 'other', p_brand) AS hash")), "SELECT p_partkey AS name, CASE WHEN p_partkey % 3 = 0 THEN 'missing' WHEN p_partkey % 5 = 0 THEN 'stale' ELSE 'current' END AS state FROM part")


def _decisions(spark, d):
    return table(spark, d, "events").selectExpr("concat('f', user_id) AS finding_id", "CASE event_id % 5 WHEN 0 THEN 'sensitive' WHEN 1 THEN 'safe' WHEN 2 THEN 'duplicate' WHEN 3 THEN 'escalate' ELSE 'unknown' END AS disposition", "event_type AS note", "if(event_id % 11 = 0, NULL, 'hash') AS output_sha256", "event_id AS decided_at")


_decisions_sql = "SELECT concat('f', user_id) AS finding_id, CASE event_id % 5 WHEN 0 THEN 'sensitive' WHEN 1 THEN 'safe' WHEN 2 THEN 'duplicate' ELSE 'escalate' END AS disposition, event_type AS note, event_id AS decided_at FROM events WHERE event_id % 5 < 4 AND event_id % 11 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"
add("decisions_latest", lambda spark, d: triage.latest_decisions(_decisions(spark, d)).drop("output_sha256"), _decisions_sql)
_found = "concat('f', c_custkey) AS finding_id", "c_mktsegment AS category"
add("findings_with_decisions", lambda spark, d: triage.with_decisions(table(spark, d, "customer").selectExpr(*_found), triage.latest_decisions(_decisions(spark, d))), f"WITH x AS ({_decisions_sql}) SELECT f.finding_id, category, disposition, note FROM (SELECT {', '.join(_found)} FROM customer) f LEFT JOIN x USING (finding_id)")
add("promotion_preview", lambda spark, d: triage.promotion_preview(table(spark, d, "customer").selectExpr(*_found), triage.latest_decisions(_decisions(spark, d))), f"WITH x AS ({_decisions_sql}) SELECT f.finding_id, category, CASE disposition WHEN 'duplicate' THEN 'denylist' ELSE 'lexicon' END AS goes_to FROM (SELECT {', '.join(_found)} FROM customer) f JOIN x USING (finding_id) WHERE disposition IN ('duplicate', 'safe')")
add("finding_ids", lambda spark, d: triage.finding_ids(view(spark, d, "v_box").select("doc_id", "page", "category", F.expr("cast(id % 9 AS string)").alias("digest"), F.col("id").alias("ord"))).select("ord", "finding_id"), with_views("v_box") + "SELECT id AS ord, concat_ws(':', doc_id, page, category, id % 9, row_number() OVER (PARTITION BY doc_id, page, category, id % 9 ORDER BY id)) AS finding_id FROM v_box")
add("by_language", lambda spark, d: evaluate.by_tag(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").selectExpr("if(lang = 'de', NULL, array(lang, source)) AS tags", "quality AS hits", "1 AS total"), "tags"), "SELECT tag, sum(quality)::BIGINT AS hits, count(*) AS total FROM (SELECT unnest(CASE WHEN lang = 'de' THEN ['unknown'] ELSE [lang, source] END) AS tag, quality FROM documents JOIN labels USING (doc_id)) GROUP BY 1")


def _golden(spark, d):
    rows = view(spark, d, "v_short").selectExpr("text AS term", "CASE WHEN id % 12 IN (4, 7) THEN 'manufacturer' WHEN id % 12 = 6 THEN 'boilerplate' WHEN id % 12 = 9 THEN 'party' ELSE 'structural' END AS verdict")
    return suppress.distinct_rows(rows, "term", "verdict")


add(
    "golden_eval",
    lambda spark, d: evaluate.outcomes(evaluate.classify(_golden(spark, d), Policy(terms=("almond antique", "Hatco")))).drop("rejected"),
    "SELECT verdict, count(*) FILTER (action = 'redacted') AS redacted, count(*) FILTER (action = 'suppressed') AS suppressed, count(*) FILTER (action = 'passed') AS passed FROM (SELECT CASE WHEN id % 12 IN (4, 7) THEN 'manufacturer' WHEN id % 12 = 6 THEN 'boilerplate' WHEN id % 12 = 9 THEN 'party' ELSE 'structural' END AS verdict, CASE WHEN regexp_matches(text, '(?i)(^|[^A-Z0-9])(Hatco|almond[\\s\\-]+antique)([^A-Z0-9]|$)') THEN 'redacted' WHEN reason IS NOT NULL THEN 'suppressed' ELSE 'passed' END AS action FROM (" + ORACLES["suppression_reason"].replace("SELECT id, coalesce(", "SELECT id, x AS text, coalesce(") + ")) GROUP BY 1",
)
add("golden_metrics", lambda spark, d: evaluate.metrics(evaluate.outcomes(evaluate.classify(_golden(spark, d), Policy(terms=("almond antique", "Hatco"))))))

# -- redaction ---------------------------------------------------------------------------------

add(
    "redact_text",
    lambda spark, d: redact(view(spark, d, "v_mail").withColumnRenamed("id", "doc_id"), scan.scan(view(spark, d, "v_mail").withColumnRenamed("id", "doc_id"), categories=("email",))),
    with_views("v_mail") + f"SELECT id AS doc_id, regexp_replace(text, {quoted(_email)}, '[EMAIL]', 'g') AS text FROM v_mail",
)
add(
    "redact_documents",
    lambda spark, d: redact(docs := spread(table(spark, d, "documents").select("doc_id", "text")), scan.scan(docs, categories=("email",)), mask="█").select("doc_id", F.sha2("text", 256).alias("digest")),
)
add("engine_report", lambda spark, d: _engine_report(spark, d))


def _residuals(spark, d):
    """Everything but phone numbers is redacted: those are what a reader of the output still finds."""
    docs, e = spread(table(spark, d, "documents").select("doc_id", "text")), Engine(POLICY)
    out = e.redact(docs, keep=("phone",))
    return e.residuals(out).select("doc_id", "category", "shape")


_marked = f"unnest(regexp_extract_all(text, {quoted(_GUARDED['phone'])}, 2)) AS m"
add("engine_residuals", _residuals, f"SELECT doc_id, 'phone' AS category, regexp_replace(regexp_replace(regexp_replace(m, '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g'), '[0-9]', '9', 'g') AS shape FROM (SELECT doc_id, {_marked} FROM documents)")
add("engine_sweep_leaves_nothing", lambda spark, d: (e := Engine(POLICY)).residuals(e.sweep(e.redact(spread(table(spark, d, "documents").select("doc_id", "text")), mark=True))).groupBy().agg(F.count("*").alias("residuals")), "SELECT 0::BIGINT AS residuals")


def _engine_report(spark, d):
    docs, e = spread(table(spark, d, "documents").select("doc_id", "text")), Engine(POLICY)
    return e.report(docs).withColumns({"redactions": F.to_json("redactions"), "suppressed": F.to_json("suppressed")})


# -- runs ----------------------------------------------------------------------------------------

_page = "l_orderkey % 500 AS doc_id, l_linenumber AS page"


def _reports(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey AS doc_id", "o_orderstatus AS release_status", "o_custkey % 40 AS pages", "o_custkey % 7 AS rendered")


_reports_sql = "WITH r AS (SELECT o_orderkey AS doc_id, o_orderstatus AS release_status, o_custkey % 40 AS pages, o_custkey % 7 AS rendered FROM orders) "
add("status_counts", lambda spark, d: runs.status_counts(_reports(spark, d)), _reports_sql + "SELECT release_status, count(*) AS documents FROM r GROUP BY 1")
add("run_statistics", lambda spark, d: runs.run_statistics(_reports(spark, d)), _reports_sql + "SELECT count(*) AS documents, sum(pages)::BIGINT AS pages, sum(rendered)::BIGINT AS rendered FROM r")
add(
    "manifest_payload",
    lambda spark, d: runs.manifest_payload(_reports(spark, d), "run").select("schema_version", "run_id", F.to_json("statistics").alias("statistics"), F.to_json("states").alias("states")),
    _reports_sql + """SELECT 1 AS schema_version, 'run' AS run_id, (SELECT '{"documents":' || count(*) || ',"pages":' || sum(pages) || ',"rendered":' || sum(rendered) || '}' FROM r) AS statistics,
        (SELECT '{' || string_agg('"' || release_status || '":' || n, ',' ORDER BY release_status) || '}' FROM (SELECT release_status, count(*) AS n FROM r GROUP BY 1)) AS states""",
)
add(
    "report_payload",
    lambda spark, d: runs.report_payload(_reports(spark, d), "run", "FAIL").select("schema_version", "run_id", "status", F.to_json("document").alias("document")),
    _reports_sql + """SELECT 4 AS schema_version, 'run' AS run_id, 'FAIL' AS status, '{"doc_id":' || doc_id || ',"release_status":"' || release_status || '","pages":' || pages || ',"rendered":' || rendered || '}' AS document FROM r""",
)
add("residual_split", lambda spark, d: runs.residual_split(view(spark, d, "v_box")), with_views("v_box") + "SELECT doc_id, count(*) FILTER (category = 'denylist') AS denylist, count(*) FILTER (category <> 'denylist') AS direct FROM v_box GROUP BY 1")
add(
    "checks_pass",
    lambda spark, d: runs.checks_pass(table(spark, d, "lineitem").selectExpr("l_orderkey AS doc_id", "concat('check ', l_linenumber) AS check", "if(l_partkey % 50 = 1, NULL, l_suppkey % 40 <> 1) AS ok")).select("doc_id", "passed", F.array_join("failed", "|").alias("failed")),
    "SELECT l_orderkey AS doc_id, bool_and(ok) AS passed, coalesce(string_agg(DISTINCT c, '|' ORDER BY c) FILTER (NOT ok), '') AS failed FROM (SELECT l_orderkey, 'check ' || l_linenumber AS c, l_partkey % 50 <> 1 AND l_suppkey % 40 <> 1 AS ok FROM lineitem) GROUP BY 1",
)
add(
    "page_mismatches",
    lambda spark, d: runs.page_mismatches(*[table(spark, d, "orders").where(f"o_orderkey % {k} > 0").selectExpr("o_orderkey AS doc_id", "1 AS page", "612 AS width", f"if(o_orderkey % 11 = {k}, 700, 792) AS height") for k in (7, 9)]),
    "SELECT o_orderkey AS doc_id, 1 AS page, CASE WHEN o_orderkey % 9 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'added' ELSE 'size' END AS problem FROM orders WHERE NOT (o_orderkey % 7 = 0 AND o_orderkey % 9 = 0) AND (o_orderkey % 7 = 0 OR o_orderkey % 9 = 0 OR o_orderkey % 11 IN (7, 9))",
)
add(
    "output_hashes",
    lambda spark, d: runs.output_hashes(table(spark, d, "part").selectExpr("p_partkey AS doc_id"), table(spark, d, "part").where("p_size > 9").selectExpr("p_partkey AS doc_id", "p_brand AS output_sha256")),
    "SELECT p_partkey AS doc_id, CASE WHEN p_size > 9 THEN p_brand END AS output_sha256, CASE WHEN p_size > 9 THEN NULL ELSE 'no output in the manifest: ' || p_partkey END AS error FROM part",
)
add(
    "document_terms",
    lambda spark, d: runs.document_terms(table(spark, d, "region").selectExpr("r_name AS term"), table(spark, d, "customer").selectExpr("c_custkey % 120 AS doc_id", "c_mktsegment AS term"), table(spark, d, "supplier").selectExpr("s_suppkey AS doc_id")),
    "SELECT s_suppkey AS doc_id, r_name AS term FROM supplier, region UNION SELECT c_custkey % 120, c_mktsegment FROM customer WHERE c_custkey % 120 IN (SELECT s_suppkey FROM supplier)",
)
add("raster_pages", lambda spark, d: runs.raster_pages(*[table(spark, d, "lineitem").where(f"l_returnflag = '{f}'").selectExpr(*_page.split(", ")) for f in "AR"]), f"SELECT DISTINCT {_page} FROM lineitem WHERE l_returnflag IN ('A', 'R')")
add(
    "finding_order",
    lambda spark, d: runs.in_order(table(spark, d, "lineitem").groupBy(F.expr("l_suppkey % 20").alias("doc_id"), F.col("l_returnflag").alias("label"), F.expr("concat(if(l_partkey % 2 = 0, 'P', 'q'), l_partkey)").alias("form")).agg(F.count("*").alias("occurrences"))),
    "SELECT doc_id, label, form, occurrences, row_number() OVER (PARTITION BY doc_id ORDER BY occurrences DESC, label, lower(form), form) AS rank FROM (SELECT l_suppkey % 20 AS doc_id, l_returnflag AS label, CASE l_partkey % 2 WHEN 0 THEN 'P' ELSE 'q' END || l_partkey AS form, count(*) AS occurrences FROM lineitem GROUP BY 1, 2, 3)",
)
add(
    "merged_streams",
    lambda spark, d: spatial.dedupe_half_points(runs.merged_streams(*[_boxes(spark, d).where(F.col("category") == c).withColumn("ord", F.col("id")) for c in ("street_address", "email", "denylist", "person name")]).withColumn("at", F.col("stream") * F.lit(10**15) + F.col("ord")), order="at").groupBy("category").agg(F.count("*").alias("redactions")),
    with_views("v_box") + """, s AS (SELECT *, CASE category WHEN 'street_address' THEN 0 WHEN 'email' THEN 1 WHEN 'denylist' THEN 2 ELSE 3 END AS stream FROM v_box WHERE x1 > x0 AND y1 > y0)
        SELECT category, count(*) AS redactions FROM (SELECT category FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, page, round_even(x0 * 2, 0), round_even(y0 * 2, 0), round_even(x1 * 2, 0), round_even(y1 * 2, 0) ORDER BY stream, id) = 1) GROUP BY 1""",
)
add(
    "match_totals",
    lambda spark, d: runs.match_totals(table(spark, d, "lineitem").selectExpr(*_page.split(", "), "if(l_returnflag = 'N', 'extracted', 'rendered') AS surface")),
    f"SELECT doc_id, page, count(*) FILTER (f = 'N') AS extracted, count(*) FILTER (f <> 'N') AS rendered FROM (SELECT {_page}, l_returnflag AS f FROM lineitem) GROUP BY ROLLUP (doc_id, page) HAVING doc_id IS NOT NULL",
)
add(
    "document_rows",
    lambda spark, d: runs.document_rows(_items(spark, d)[0], evaluate.match_items(*_items(spark, d))).select("doc_id", "total", "missed", F.round("recall", 9).alias("recall")),
    _items_sql + "SELECT i.doc_id, count(*) AS total, count(m.item_id) AS missed, round(1 - count(m.item_id) / count(*), 9) AS recall FROM i LEFT JOIN m ON i.doc_id = m.doc_id AND i.id = m.item_id GROUP BY 1",
)
add("finished_runs", lambda spark, d: runs.finished_runs(table(spark, d, "orders").selectExpr("o_orderkey AS name", "nullif(if(o_orderstatus = 'F', 'complete', o_orderstatus), 'P') AS review")).select("name"), "SELECT o_orderkey AS name FROM orders WHERE o_orderstatus = 'F'")
add(
    "until_failure",
    lambda spark, d: runs.until_failure(table(spark, d, "orders").selectExpr("o_orderkey AS ord", "o_orderkey % 997 = 500 AS failed")).select("ord", "state"),
    "SELECT o_orderkey AS ord, CASE WHEN o_orderkey < x THEN 'done' WHEN o_orderkey = x THEN 'FAIL' ELSE 'not_started' END AS state FROM orders, (SELECT min(o_orderkey) FILTER (o_orderkey % 997 = 500) AS x FROM orders)",
)
add(
    "area_ratio",
    lambda spark, d: runs.area_ratio(_boxes(spark, d), _boxes(spark, d).select("doc_id", "page").distinct().withColumn("rect", R.rect(*map(F.lit, (0.0, 0.0, 612.0, 792.0))))).select("doc_id", "page", F.round("ratio", 9).alias("ratio")),
    with_views("v_box") + "SELECT doc_id, page, round(sum((x1 - x0) * (y1 - y0)) / (612.0::DOUBLE * 792), 9) AS ratio FROM v_box GROUP BY 1, 2",
)


# -- detections with rectangles --------------------------------------------------------------------

_EMAIL, _URL = (V.DIRECT_PATTERNS[c] for c in ("email", "url"))


def _plan_lines(spark, d):
    return view(spark, d, "v_plan").withColumn("words", F.array().cast("array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>"))


add(
    "line_detections",
    lambda spark, d: detections.line_detections(_plan_lines(spark, d), Policy(terms=("Maren",))).select("doc_id", "category", "detector", "text", "rect.x0", "rect.y0"),
    with_views("v_plan")
    + f""", {_values_sql('v_plan', 120)}
    SELECT doc_id, 'email' AS category, 'pattern' AS detector, unnest(regexp_extract_all(text, {quoted(_EMAIL)})) AS text, x0, y0 FROM v_plan UNION ALL SELECT doc_id, 'url', 'pattern', unnest(regexp_extract_all(text, {quoted(_URL)})), x0, y0 FROM v_plan
    UNION ALL SELECT doc_id, 'denylist', 'denylist', 'Maren', x0, y0 FROM v_plan WHERE contains(text, 'Maren')
    UNION ALL SELECT doc_id, 'labelled_identifier', 'label', regexp_extract(text, {quoted(_LV)}, 1), x0, y0 FROM v_plan WHERE regexp_matches(text, {quoted(_LV)})
    UNION ALL SELECT doc_id, 'labelled_identifier', 'label', raw, x0, y0 FROM w""",
)
add(
    "ocr_detections",
    lambda spark, d: detections.ocr_detections(view(spark, d, "v_ocr"), POLICY, 2.0).groupBy("doc_id", "category", "text", "rect.x0", "rect.y0", "rect.x1", "rect.y1").agg(F.count("*").alias("n")),
    with_views("v_ocr") + """, m AS (SELECT * FROM v_ocr WHERE contains(text, '@')), c AS (SELECT *, 'email' AS category, text AS t FROM m UNION ALL SELECT *, 'url', 'example.com' FROM m)
    SELECT doc_id, category, t AS text, "left" / 2.0::DOUBLE AS x0, top / 2.0::DOUBLE AS y0, ("left" + 80) / 2.0::DOUBLE AS x1, (top + 10) / 2.0::DOUBLE AS y1, count(*) AS n FROM c GROUP BY ALL""",
)
add(
    "map_labels",
    lambda spark, d: detections.map_labels(view(spark, d, "v_map")).select("doc_id", "page", "label_id"),
    with_views("v_map") + rf"SELECT doc_id, page, ord AS label_id FROM v_map WHERE regexp_matches(text, '(?i)\b(vicinity|location|site|area)\s+map\b')",
)


def _margin_images(spark, d):
    images = table(spark, d, "lineitem").selectExpr("l_partkey % 97 AS doc_id", "l_suppkey AS image_id", "l_linenumber AS page", "named_struct('x0', l_linenumber * 100D, 'y0', l_linenumber * 100D, 'x1', l_linenumber * 100D + 60, 'y1', l_linenumber * 100D + 40) AS rect")
    pages = images.select("doc_id", "page").distinct().withColumns({"width": F.lit(612.0), "height": F.lit(792.0)})
    return spatial.repeated_margin_images(images, pages, crowd=90)[0].select("doc_id", "page", "image_id")


add(
    "repeated_margin_images",
    _margin_images,
    """WITH i AS (SELECT l_partkey % 97 AS doc_id, l_suppkey AS image_id, l_linenumber AS page FROM lineitem), k AS (SELECT DISTINCT * FROM i WHERE image_id > 0 AND (doc_id, page) NOT IN (SELECT (doc_id, page) FROM i GROUP BY doc_id, page HAVING count(*) > 90))
    SELECT doc_id, page, image_id FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, image_id) AS n FROM k) WHERE n >= 3 AND (page * 100 + 40 <= 0.2 * 792 OR page * 100 >= 0.8 * 792 OR page * 100 >= 0.8 * 612)""",
)
RULES = independent.Rules({"email": _EMAIL, "url": _URL}, labels.LABEL, labels.LABEL_VALUE, V.FEET_INCHES, terms=("Maren",))
add(
    "independent_lines",
    lambda spark, d: independent.scan_lines(view(spark, d, "v_plan").withColumn("grp", F.col("block")), RULES),
    with_views("v_plan")
    + f""", l AS (SELECT * FROM v_plan WHERE regexp_matches(text, {quoted(_L)})), v AS (SELECT * FROM v_plan WHERE NOT regexp_matches(text, {quoted(_L)})),
    h AS (SELECT doc_id, page, 'email' AS category, unnest(regexp_extract_all(text, {quoted(_EMAIL)})) FROM v_plan UNION ALL SELECT doc_id, page, 'url', unnest(regexp_extract_all(text, {quoted(_URL)})) FROM v_plan
        UNION ALL SELECT doc_id, page, 'labelled_identifier', '' FROM v_plan WHERE regexp_matches(text, {quoted(_LV)})
        UNION ALL SELECT doc_id, page, 'labelled_identifier', '' FROM l WHERE EXISTS (SELECT 1 FROM v WHERE v.doc_id = l.doc_id AND v.ord > l.ord AND v.y0 - l.y1 <= 72)
        UNION ALL SELECT doc_id, page, 'denylist', '' FROM v_plan WHERE contains(text, 'Maren')
        UNION ALL SELECT doc_id, page, 'denylist', '' FROM v_plan GROUP BY doc_id, page, block HAVING count(*) > 1 AND count(*) FILTER (contains(text, 'Maren')) > 0)
    SELECT doc_id, page, category, count(*) AS hits FROM h GROUP BY ALL""",
)


def _remediation(spark, d):
    docs, e = spread(table(spark, d, "documents").select("doc_id", "text")), Engine(POLICY)
    out = e.redact(docs, keep=("phone",))
    return e.remediate(out).select("doc_id", F.array_join("remediated", ",").alias("remediated"), "passed")


_phones = f"coalesce(regexp_matches(text, {quoted(_GUARDED['phone'])}), false)"
add("remediation", _remediation, f"SELECT doc_id, CASE WHEN {_phones} THEN 'phone' ELSE '' END AS remediated, NOT {_phones} AS passed FROM documents")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches and documents of every identifier category; a row for each category, zeros included."""
    return _count_by_category(spark, sf_dir)

