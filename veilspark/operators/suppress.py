"""Why a candidate is an artefact of the document, as ordered rules; the first that holds is the reason."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import policy_values as V
from ..functions import text as T
from ..policy import Policy, java
from .layout import tasks

_BARE = " \t.,:;-—–'’\"()[]{}*#|_"


def _one_of(x: Column, values) -> Column:
    return x.isin(*sorted(values)) if values else F.lit(False)


def first_phrase(folded: Column, phrases: tuple[str, ...]) -> Column:
    """The first phrase that the folded text contains, in the list's order, or null; the text is folded once, not for each phrase."""
    if not phrases:
        return F.lit(None).cast("string")
    known = F.array(*[F.lit(p) for p in phrases])
    return F.get(F.transform(F.array(folded), lambda t: F.get(F.filter(known, lambda p: F.contains(t, p)), F.lit(0))), F.lit(0))


def distinct_rows(df: DataFrame, *columns: str) -> DataFrame:
    """(columns, n): rows that are equal once with their number, dealt to a few tasks a core, so that rules are tried once for each value and by all cores."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).repartition(tasks(df))


def structural_name(x: Column, policy: Policy) -> Column:
    """The first rule that is the whole value or the whole bare value; one test of all rules goes first, as most values are none."""
    if not policy.structural:
        return F.lit(None).cast("string")
    plain = not any(re.search(r"\\[1-9k]|\(\?(?:<[A-Za-z]|[a-zA-Z])", p) for _, p in policy.structural)  # else they can't share one pattern
    every = java(rf"(?i)\A(?:{'|'.join(f'(?:{p})' for _, p in policy.structural)})\z")

    def named(x: Column, bare: Column) -> Column:
        rules = [F.when(x.rlike(r := java(rf"(?i)\A(?:{p})\z")) | ((bare != "") & bare.rlike(r)), F.lit(name)) for name, p in policy.structural]
        return F.when(x.rlike(every) | ((bare != "") & (bare != x) & bare.rlike(every)), F.coalesce(*rules)) if plain else F.coalesce(*rules)

    return T.let(x, lambda x: T.let(T.strip(x, _BARE), lambda bare: named(x, bare)))


def suppression_reason(x: Column, policy: Policy) -> Column:
    def first(x: Column) -> Column:
        defined, allowed = T.defined_key(x, policy.defined_strip, policy.defined_affixes), T.allow_key(x, policy.allow_strip, policy.allow_suffixes, policy.allowed)
        return F.coalesce(
            F.when(x == "", F.lit("empty")),
            T.let(defined, lambda d: F.when(_one_of(d, policy.defined), F.concat(F.lit("contract_defined_term:"), d))),
            T.let(allowed, lambda a: F.when(_one_of(a, policy.allowed), F.concat(F.lit("shared_allowlist:"), a))),
            F.concat(F.lit("structural:"), structural_name(x, policy)),
            F.concat(F.lit("boilerplate:"), first_phrase(T.fold(x), policy.boilerplate)),
        )

    return T.let(F.trim(T.collapse(x)), first)


def boilerplate_context(x: Column, policy: Policy) -> Column:
    return first_phrase(T.fold(F.trim(T.collapse(x))), policy.boilerplate)


def candidate_suppression(category: Column, x: Column, policy: Policy, cells: Column | None = None, context: Column | None = None) -> Column:
    """The one decision that detection, the second pass and verification share. The denylist is never ruled out."""
    rules = []
    if context is not None:
        rules.append(F.when((category == "street_address") & context.rlike(java(V.FEET_INCHES)), F.lit("structural:feet_inches_dimension")))
    if cells is not None:
        rules.append(F.when((cells >= 2) & category.isin(*V.TABLE_FRAGILE), F.concat(F.lit("table_zone:multi_cell_"), category)))
    rules.append(suppression_reason(x, policy))
    if context is not None:
        rules.append(F.concat(F.lit("boilerplate_context:"), boilerplate_context(context, policy)))
    return F.when(category != "denylist", F.coalesce(*rules))


def product_window(text: Column, start: Column, end: Column) -> Column:
    """What lies around a span, as far as a product phrase is sought."""
    low = F.greatest(F.lit(0), start - V.PRODUCT_WINDOW)
    return text.substr(low + 1, end + V.PRODUCT_WINDOW - low)


def product_phrase(near: Column, policy: Policy) -> Column:
    return first_phrase(T.fold(near), policy.products)


def product_evidence(text: Column, start: Column, end: Column, policy: Policy) -> Column:
    """A product phrase near the span; evidence only."""
    return product_phrase(product_window(text, start, end), policy)


def identifier_shaped(x: Column) -> Column:
    shapes = [java(V.DIRECT_PATTERNS[c]) for c in ("street_address", "city_state_zip", "email", "url", "phone", "po_box")]
    out = x.rlike(r"[A-Za-z]:\\|\\\\|(?:/[A-Za-z0-9_.-]+){2,}|\.[A-Za-z0-9]{2,4}$") | x.rlike(java(r"\A[A-Za-z]{2,6}\s*[-_]?\s*\d{3,8}[A-Za-z0-9 -]*\z"))
    for s in shapes:
        out |= x.rlike(s)
    return out


def shape_rejection(x: Column) -> Column:
    """Why a phrase is too long, too odd or prose; null if it isn't."""
    tokens, words = F.regexp_extract_all(x, F.lit(java(r"\S+")), F.lit(0)), F.regexp_extract_all(x, F.lit(java(r"\w+")), F.lit(0))
    n, letters = F.length(x), F.length(F.regexp_replace(x, r"\P{L}", ""))
    odd = n - F.length(F.translate(x, V.MOJIBAKE_GLYPHS, ""))
    flip = F.exists(tokens, lambda t: (lambda b: b.rlike(r"^[A-Za-z]{4,}$") & ~b.rlike("^(?:Mc|Mac|De|Di|La|Le|Van|Von|O)[A-Z]") & b.rlike("[a-z][A-Z]"))(F.btrim(t, F.lit(".,:;'\"()[]-"))))
    first = F.get(F.filter(words, lambda w: w.rlike(r"^\p{L}")), F.lit(0))
    function = F.size(F.filter(words, lambda w: F.lower(w).isin(*V.FUNCTION_WORDS)))
    prose = T.let(function, lambda n: F.when(n >= V.MAX_FUNCTION_WORDS, F.lit("prose:function_words")).when((n > 0) & (F.size(words) >= V.PROSE_TOKEN_THRESHOLD), F.lit("prose:long_with_function_word")))
    return F.coalesce(
        F.when(odd / n > V.MAX_MOJIBAKE_RATIO, F.lit("mojibake")),
        F.when(F.size(tokens) > V.MAX_TOKENS, F.concat(F.lit("too_many_tokens:"), F.size(tokens))),
        F.when(F.length(F.regexp_replace(x, r"[^\p{L}\p{Nd}]", "")) < V.MIN_ALNUM_CHARS, F.lit("too_few_alnum_chars")),
        F.when(letters / n < V.MIN_ALPHA_RATIO, F.lit("low_alpha_ratio")),
        F.when(x.rlike(java(r"\w[._]{2,}\w")), F.lit("garbage:repeated_punctuation")),
        F.when(x.rlike("[a-z][A-Z]") & flip, F.lit("garbage:internal_case_flip")),
        F.when(x.endswith(".") & first.rlike(r"^\p{Ll}") & (F.lower(first) == first), F.lit("prose:sentence_fragment")),
        prose,
    )


def proposal_rejection(x: Column, policy: Policy) -> Column:
    """Why a phrase mustn't become a denylist term; null if it may."""

    def first(x: Column) -> Column:
        glyphs = [F.when(F.contains(x, F.lit(g)), F.lit(f"glyph:{g}")) for g in V.REJECTED_GLYPHS]
        odd = T.let(shape_rejection(x), lambda why: F.when(why.isNotNull() & ~identifier_shaped(x), why))  # few phrases have an odd shape, so most aren't tried for identifiers
        return F.coalesce(F.when(x == "", F.lit("empty")), *glyphs, odd, suppression_reason(x, policy))

    return T.let(F.trim(T.collapse(x)), first)
