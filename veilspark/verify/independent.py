"""A second, separate implementation of the policy that checks outputs; it imports nothing of the engine.

It is stricter about terms (any separators between their pieces) and looks at lines and at whole texts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SEPARATORS = r"[\s\-‐-―−.,]*"


def loose_terms(terms: Iterable[str]) -> str:
    """One alternation; (?!) without terms."""
    made = [_SEPARATORS.join(re.escape(p) for p in re.split(r"[\s\-‐-―−.,]+", t) if p) for t in sorted({t.strip() for t in terms if len(t.strip()) >= 3}, key=lambda t: (-len(t), t.lower()))]
    return rf"(?iU)(?<![A-Z0-9])(?:{'|'.join(m for m in made if m) or '(?!)'})(?![A-Z0-9])"


def masked(value):
    """Upper case A, lower case a, digits 9, at most 80 characters."""
    for pattern, by in ((r"\p{Lu}", "A"), (r"[\p{L}&&[^A]]", "a"), (r"\p{Nd}", "9")):
        value = F.regexp_replace(value, pattern, by)
    return F.left(value, F.lit(80))


def verify_texts(docs: DataFrame, terms: Iterable[str], patterns: dict[str, str], allowed: Iterable[str] = ()) -> DataFrame:
    """(doc_id, category, hits): what whole texts still hold of terms and of the given patterns, exact spans in ``allowed`` aside."""
    safe = sorted({a.lower() for a in allowed})
    every = {"denylist": loose_terms(terms), **{c: f"(?U){p}" for c, p in patterns.items()}}
    groups = F.array(*[F.struct(F.lit(c).alias("category"), F.when(F.col("text").rlike(p), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("found")) for c, p in every.items()])
    rows = docs.select("doc_id", F.explode(groups).alias("g")).select("doc_id", "g.category", F.explode("g.found").alias("hit"))
    if safe:
        rows = rows.where(~F.lower(F.trim("hit")).isin(*safe) | (F.col("category") == "denylist"))
    return rows.groupBy("doc_id", "category").agg(F.count("*").alias("hits"))


def verify_lines(docs: DataFrame, terms: Iterable[str]) -> DataFrame:
    """(doc_id, spans): distinct (first line, last line) spans that hold a term, over whole texts."""
    p = loose_terms(terms)
    marked = F.split(F.regexp_replace("text", f"({p})", "\u0001$1\u0002"), "[\u0001\u0002]")
    rows = docs.where(F.col("text").rlike(p)).select("doc_id", marked.alias("p"))
    breaks = F.transform("p", lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))))
    rows = rows.select("doc_id", F.posexplode(breaks).alias("k", "n"), breaks.alias("b"))
    first = F.aggregate(F.slice("b", F.lit(1), F.col("k")), F.lit(0), lambda a, x: a + x)
    return rows.where("k % 2 = 1").select("doc_id", first.alias("a"), (first + F.col("n")).alias("z")).distinct().groupBy("doc_id").agg(F.count("*").alias("spans"))


def all_strings(node: object) -> Iterator[str]:
    """Every string of a JSON value, however deep; keys that begin with _ are private."""
    children = [v for k, v in node.items() if not k.startswith("_")] if isinstance(node, dict) else node if isinstance(node, list) else []
    if isinstance(node, str):
        yield node
    for child in children:
        yield from all_strings(child)


def read_terms(*texts: str) -> list[str]:
    """Terms of three characters or more in JSON texts, longer ones first."""
    found = {t.strip() for text in texts for t in all_strings(json.loads(text))}
    return sorted((t for t in found if len(t) >= 3), key=lambda t: (-len(t), t.casefold()))


@dataclass(frozen=True)
class Rules:
    """What the verifier is told: patterns by category, label patterns and the vocabularies, all as plain values."""

    patterns: dict[str, str]
    label: str
    label_value: str
    dimension: str
    terms: tuple[str, ...] = ()
    defined: tuple[str, ...] = ()
    defined_strip: str = " "
    defined_affixes: tuple[str, ...] = ()
    allowed: tuple[str, ...] = ()
    allow_strip: str = " "
    allow_suffixes: tuple[str, ...] = ()
    structural: tuple[str, ...] = ()
    boilerplate: tuple[str, ...] = ()


def _squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def _among(x: Column, values: Iterable[str]) -> Column:
    known = sorted({v.lower() for v in values})
    return x.isin(*known) if known else F.lit(False)


def suppressed(category: Column, value: Column, context: Column, rules: Rules) -> Column:
    """Whether a hit is an artefact of the document; terms never are."""
    x = F.lower(_squeezed(value))
    defined, allowed = F.btrim(x, F.lit(rules.defined_strip)), F.btrim(x, F.lit(rules.allow_strip))
    bare, around = F.btrim(x, F.lit(" \t.,:;-—–'’\"()[]{}*#|_")), F.lower(context)
    out = (category == "street_address") & (context.rlike(rules.dimension) | context.rlike(r"^\s*\d+\.\d+\s+"))
    out |= _among(defined, rules.defined) | _among(allowed, rules.allowed)
    for affix in map(str.lower, rules.defined_affixes):
        out |= defined.endswith(affix) & _among(F.trim(F.left(defined, F.length(defined) - len(affix))), rules.defined)
    dotless = F.rtrim(allowed, F.lit("."))
    for suffix in (s.lower().strip(" .") for s in rules.allow_suffixes):
        out |= dotless.endswith(" " + suffix) & _among(F.rtrim(F.left(dotless, F.length(dotless) - len(suffix) - 1)), rules.allowed)
    for p in rules.structural:
        whole = rf"(?iU)\A(?:{p})\z"
        out |= x.rlike(whole) | ((bare != "") & bare.rlike(whole))
    for phrase in map(str.lower, rules.boilerplate):
        out |= F.contains(x, F.lit(phrase)) | F.contains(around, F.lit(phrase))
    return F.coalesce(out & (category != "denylist"), F.lit(False))


def value_candidate(label: Column, value: Column) -> Column:
    """Whether a line can be a label's value: any phrase under a numeric label, else four letters and no dimension signs."""
    x = F.btrim(F.regexp_replace(value, r"(?U)\s+", " "), F.lit(" \t:;,-"))
    phrase = F.length(x).between(2, 180) & x.rlike("[A-Za-z0-9]") & x.rlike(r"[\p{L}\p{Nd}]")
    numeric = label.rlike(r"(?i)\b(?:permit|application|project|job|parcel|APN|lot)\b")
    letters = F.length(F.regexp_replace(value, r"\P{L}", ""))
    return phrase & (numeric | (~value.rlike(r"\d\s*['\"ø]|['\"ø]\s*\d") & (letters >= 4)))


def lines_of_spans(spans: DataFrame) -> DataFrame:
    """spans(doc_id, page, block, line, span, text, x0, y0, x1, y1 of the line) to lines: spans joined with nothing between."""
    parts = F.sort_array(F.collect_list(F.struct("span", "text")))
    lines = spans.groupBy("doc_id", "page", "block", "line").agg(parts.alias("p"), *[F.first(k).alias(k) for k in ("x0", "y0", "x1", "y1")])
    text = F.trim(F.array_join(F.transform("p", lambda s: s["text"]), ""))
    return lines.select("doc_id", "page", F.struct("block", F.lit(0).alias("part")).alias("grp"), F.struct("block", "line").alias("ord"), text.alias("text"), "x0", "y0", "x1", "y1").where("text <> ''")


def scan_lines(lines: DataFrame, rules: Rules, per_point: float = 1.0, page: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """(page, category, hits) over lines(page, ord, grp, text, x0, y0, x1, y1), read from top to bottom.

    A term counts once for each distinct span of lines, single lines and groups (grp; null: a line of its own) together. The
    first acceptable line within 72 points under a lone label is its value. Lines at the same place are ordered by ``ord``.
    """
    seen = Window.partitionBy(*page).orderBy("y0", "x0", "ord")
    rows = lines.withColumn("text", _squeezed(F.col("text"))).where("text <> ''").withColumn("i", F.row_number().over(seen))
    term = loose_terms(rules.terms)
    own = F.to_json(F.struct(F.coalesce(F.to_json(F.struct("grp")), F.lit("")).alias("g"), F.when(F.col("grp").isNull(), F.col("i")).alias("i")))
    groups = rows.withColumn("__g", own).groupBy(*page, "__g").agg(F.sort_array(F.collect_list(F.struct("i", "text"))).alias("m"))
    groups = groups.where(F.array_join(F.transform("m", lambda r: r["text"]), "\n").rlike(term)).select(*page, F.col("m")[0]["i"].alias("a"), F.element_at("m", -1)["i"].alias("z"))
    spans = rows.where(F.col("text").rlike(term)).select(*page, F.col("i").alias("a"), F.col("i").alias("z")).union(groups).distinct()
    spans = spans.select(*page, F.lit("denylist").alias("category"))
    hits = [F.struct(F.lit(c).alias("category"), F.when(F.col("text").rlike(f"(?U){p}"), F.regexp_extract_all("text", F.lit(f"(?U)({p})"), F.lit(1))).otherwise(F.array().cast("array<string>")).alias("found")) for c, p in rules.patterns.items()]
    labelled = F.when(F.col("text").rlike(rules.label_value), F.array(F.regexp_extract("text", rules.label_value, 1))).otherwise(F.array().cast("array<string>"))
    hits.append(F.struct(F.lit("labelled_identifier").alias("category"), labelled.alias("found")))
    direct = rows.select(*page, "text", F.explode(F.array(*hits)).alias("g")).select(*page, "text", "g.category", F.explode("g.found").alias("hit"))
    direct = direct.where(~suppressed(F.col("category"), F.col("hit"), F.col("text"), rules)).select(*page, "category")
    lone = F.col("text").rlike(rules.label)
    heads = rows.where(lone).select(*page, F.col("i").alias("li"), F.col("text").alias("label"), F.col("x0").alias("lx0"), F.col("x1").alias("lx1"), F.col("y1").alias("ly1"))
    kind = F.lit("labelled_identifier")
    fits = ~lone & (F.size(F.split(F.trim("text"), r"(?U)\s+")) <= 10) & ~suppressed(kind, F.col("text"), F.col("text"), rules)
    values = rows.where(fits).select(*page, "i", "text", "x0", "x1", "y0")
    near = (F.abs(F.col("x0") - F.col("lx0")) <= F.greatest(F.lit(36.0 * per_point), F.greatest(F.lit(1.0), F.col("lx1") - F.col("lx0")) * 0.5)) | (F.least("x1", "lx1") > F.greatest("x0", "lx0"))
    below = heads.join(values, list(page)).where((F.col("i") > F.col("li")) & (F.col("y0") - F.col("ly1") <= 72 * per_point) & near & value_candidate(F.col("label"), F.col("text")))
    found = below.select(*page, "li").distinct().select(*page, kind.alias("category"))
    return spans.unionByName(direct).unionByName(found).groupBy(*page, "category").agg(F.count("*").alias("hits"))


def verify_run(recorded: DataFrame, live: DataFrame, hits: DataFrame) -> DataFrame:
    """(name, state, verdict): FAIL on any hit, on a stale or missing output."""
    x = recorded.join(live.withColumnRenamed("hash", "live_hash"), "name", "left").join(hits.groupBy("name").agg(F.sum("hits").alias("hits")), "name", "left")
    state = F.when(F.col("live_hash").isNull(), "missing").when(F.col("hash") == F.col("live_hash"), "current").otherwise("stale")
    return x.select("name", state.alias("state"), F.when((state == "current") & (F.coalesce("hits", F.lit(0)) == 0), "PASS").otherwise("FAIL").alias("verdict"))
