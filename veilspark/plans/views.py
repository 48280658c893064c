"""Inputs composed from the star-schema tables by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name: (table, expressions)
VIEWS = {
    "v_project": ("orders", "o_orderkey AS id", "concat('PROJECT NO.: ', o_orderkey, '-A') AS text"),
    "v_permit": ("orders", "o_orderkey AS id", "concat('Permit # ', o_orderstatus, '-', o_orderkey, '00') AS text"),
    "v_parcel": ("orders", "o_orderkey AS id", "concat('Parcel No. ', o_custkey, '-', o_orderkey) AS text"),
    "v_addr": ("customer", "c_custkey AS id", "concat('Deliver to ', c_custkey, ' Sycamore Boulevard now') AS text"),
    "v_csz": ("customer", "c_custkey AS id", "concat('Cedar Falls, IA ', lpad(cast(c_custkey AS varchar(20)), 5, '0')) AS text"),
    "v_pobox": ("supplier", "s_suppkey AS id", "concat('Send to P.O. Box ', s_suppkey) AS text"),
    "v_cred": ("customer", "c_custkey AS id", "concat('by Maren Oldfield', ', AIA ', c_custkey) AS text"),
    "v_coord": ("customer", "c_custkey AS id", "concat('at 30.1588', ', -85.', lpad(cast(c_custkey AS varchar(20)), 5, '0')) AS text"),
    "v_path": ("part", "p_partkey AS id", "concat('C:', chr(92), 'Users', chr(92), 'x', chr(92), p_partkey, ' plan.rvt') AS text"),
    "v_deny": ("supplier", "s_suppkey AS id", "concat('Job QRX', CASE s_suppkey % 3 WHEN 0 THEN '-' WHEN 1 THEN ' - ' ELSE ' ' END, '21109', CASE s_suppkey % 5 WHEN 0 THEN '7' ELSE ' ok' END) AS text"),
    "v_phone": ("customer", "c_custkey AS id", "concat('Call (850) 555-', lpad(cast(c_custkey % 10000 AS varchar(20)), 4, '0'), ' ext. ', c_nationkey) AS text"),
    "v_mail": ("customer", "c_custkey AS id", "concat('Write to user', c_custkey, '@example.com today') AS text"),
    "v_url": ("supplier", "s_suppkey AS id", "concat('See https://host', s_suppkey, '.example.org/a?b=1 and plans.com') AS text"),
    "v_short": ("part", "p_partkey AS id", "CASE p_partkey % 12 WHEN 0 THEN concat(p_size, ' CIR') WHEN 1 THEN '32 13 13' WHEN 2 THEN '16 inches o.c.' WHEN 3 THEN concat('Owner', chr(39), 's') WHEN 4 THEN 'Hatco Corporation' WHEN 5 THEN ' ( Contractors ) ' WHEN 6 THEN 'SEE NOTE THIS SHEET for details' WHEN 7 THEN 'ASTM A36' WHEN 8 THEN concat('Article ', p_size) WHEN 9 THEN p_name WHEN 10 THEN '  ' ELSE concat('L', p_size % 9, '.0') END AS text"),
    "v_label": ("orders", "o_orderkey AS id", "CASE o_orderkey % 4 WHEN 0 THEN concat('Owner: Bay ', o_custkey, ' Holdings') WHEN 1 THEN 'Prepared by:' WHEN 2 THEN concat('Project Number - P', o_orderkey) ELSE concat('Note ', o_orderkey) END AS text"),
    "v_page": ("orders", "o_custkey % 400 AS doc_id", "o_orderkey AS ord", "CASE o_orderkey % 5 WHEN 0 THEN 'OWNER:' WHEN 1 THEN concat('Harbor ', o_custkey, ' Holdings LLC') WHEN 2 THEN 'DRAWN BY' ELSE concat('General text ', o_orderkey) END AS text", "cast(o_custkey % 3 * 30 AS double) AS x0", "cast(o_orderkey % 5000 AS double) AS y0", "cast(o_custkey % 3 * 30 + 90 AS double) AS x1", "cast(o_orderkey % 5000 + 12 AS double) AS y1"),
    "v_spec": ("orders", "o_custkey % 25 AS doc_id", "o_orderkey % 40 AS page", "o_orderkey AS line", "CASE o_orderkey % 9 WHEN 0 THEN concat('SECTION ', CASE o_custkey % 3 WHEN 0 THEN '00 11 13' WHEN 1 THEN '32 13 13' ELSE '096500' END, ' - TITLE') WHEN 4 THEN 'PART 2 - PRODUCTS' WHEN 6 THEN 'PART 3 EXECUTION' ELSE concat('text ', o_orderkey) END AS text"),
    "v_box": ("lineitem", "(l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey * 7 + l_suppkey AS id", "cast(floor(l_orderkey / 400) AS bigint) AS doc_id", "l_linenumber AS page", "cast(l_quantity AS double) AS x0", "cast(l_linenumber * 20 AS double) AS y0", "cast(l_quantity + 8 AS double) AS x1", "cast(l_linenumber * 20 + l_quantity / 4 AS double) AS y1", "CASE l_suppkey % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'street_address' WHEN 2 THEN 'denylist' ELSE 'person name' END AS category"),
    "v_plan": ("orders", "cast(floor(o_orderkey / 400) AS bigint) AS doc_id", "1 AS page", "cast(floor(o_orderkey / 8) AS bigint) AS block", "o_orderkey AS line", "o_orderkey AS ord", "CASE o_orderkey % 5 WHEN 0 THEN 'OWNER:' WHEN 1 THEN concat('Harbor ', o_custkey, ' Holdings LLC') WHEN 2 THEN concat('Write to user', o_orderkey, '@example.com') WHEN 3 THEN concat('Drawn by: Maren ', o_custkey) ELSE concat('General text ', o_orderkey) END AS text", "cast(o_custkey % 3 * 30 AS double) AS x0", "cast(o_orderkey % 400 * 20 AS double) AS y0", "cast(o_custkey % 3 * 30 + 90 AS double) AS x1", "cast(o_orderkey % 400 * 20 + 12 AS double) AS y1"),
    "v_ocr": ("lineitem", "cast(floor(l_orderkey / 400) AS bigint) AS doc_id", "1 AS page", "l_orderkey AS block", "1 AS par", "1 AS line", "CASE l_linenumber % 3 WHEN 0 THEN 'mail' WHEN 1 THEN concat('user', l_partkey, '@example.com') ELSE 'note' END AS text", "l_linenumber * 100 AS left", "l_orderkey % 400 * 30 AS top", "80 AS width", "10 AS height"),
    "v_map": ("part", "p_partkey % 50 AS doc_id", "1 AS page", "p_partkey AS ord", "CASE p_partkey % 4 WHEN 0 THEN 'Vicinity  Map' WHEN 1 THEN concat('SITE MAP ', p_size) WHEN 2 THEN 'sitemap' ELSE 'Area plan' END AS text", "1.0 AS x0", "2.0 AS y0", "3.0 AS x1", "4.0 AS y1"),
    # pages of a few hundred words each, however large the table
    "v_word": ("lineitem", "cast(floor(l_orderkey / 400) AS bigint) AS doc_id", "l_linenumber AS page", "cast((l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey * 7 + l_suppkey AS varchar(20)) AS text", "cast(l_quantity * 10 AS double) AS x", "cast(l_linenumber * 20 AS double) AS y", "cast(30 AS double) AS w", "cast(10 AS double) AS h"),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, *columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*columns)


def with_views(*names: str) -> str:
    """The same views as the head of a DuckDB query."""
    return "WITH " + ", ".join(f"{n} AS (SELECT {', '.join(VIEWS[n][1:])} FROM {VIEWS[n][0]})" for n in names) + " "
