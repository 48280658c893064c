"""Scalar string functions as column expressions; none leaves the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import policy_values as V
from ..policy import _FOLD_FROM, _FOLD_TO, java


def let(x: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is named; big expressions are run as trees, not as one huge method that the JVM won't compile."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def collapse(x: Column) -> Column:
    return F.regexp_replace(x, java(r"\s+"), " ")


def strip(x: Column, chars: str) -> Column:
    return F.btrim(x, F.lit(chars)) if chars else F.btrim(x)


def normalized(x: Column) -> Column:
    """White space runs as one space; outer separators off."""
    return strip(collapse(x), " \t:;,-")


def masked_shape(x: Column, limit: int = 80) -> Column:
    """Upper case to A, other letters to a, digits to 9; long values are cut and marked."""
    for pattern, by in ((r"\p{Lu}", "A"), (r"[\p{L}&&[^A]]", "a"), (r"\p{Nd}", "9")):
        x = F.regexp_replace(x, pattern, by)
    return F.when(F.length(x) <= limit, x).otherwise(F.concat(F.left(x, F.lit(limit)), F.lit("…")))


def redactable(x: Column, allow_short: bool = False) -> Column:
    """Whether a phrase is long and distinct enough to be a rule."""
    x = normalized(x)
    tokens = F.regexp_extract_all(x, F.lit("[A-Za-z0-9]+"), F.lit(0))
    ok = F.length(x).between(2 if allow_short else 4, 180) & (F.size(tokens) > 0)
    if not allow_short:
        ok &= (F.size(tokens) != 1) | (F.length(F.element_at(tokens, 1)) >= 7)
    return ok & x.rlike(r"[\p{L}\p{Nd}]" if allow_short else r"\p{L}")


def fold(x: Column) -> Column:
    """Typographic quotes, dashes and spaces in one form, lower case (not full case folding: ß, ſ stay)."""
    return F.lower(F.translate(x, _FOLD_FROM, _FOLD_TO))


def defined_key(x: Column, chars: str = V.DEFINED_STRIP, affixes: tuple[str, ...] = V.DEFINED_AFFIXES) -> Column:
    def cut(key: Column) -> Column:
        out = key
        for affix in reversed(affixes):
            affix = affix.translate(str.maketrans(_FOLD_FROM, _FOLD_TO)).lower()
            short = F.left(key, F.length(key) - len(affix))
            out = F.when(key.endswith(affix) & (F.length(key) > len(affix) + 1), F.trim(strip(short, " '\"-"))).otherwise(out)
        return out

    return let(fold(F.trim(strip(collapse(x), chars))), cut)


def allow_key(x: Column, chars: str = V.ALLOW_STRIP, suffixes: tuple[str, ...] = V.COMPANY_SUFFIXES, sought: frozenset[str] | None = None) -> Column:
    """Key of a name: trimmed and folded, without company suffixes. With ``sought`` it is null where it can't be one of these keys: cuts at spaces or commas leave the first word."""

    def cut(key: Column) -> Column:
        out = key
        for suffix in suffixes:
            out = F.trim(F.regexp_replace(out, java(rf"(?i)[,\s]+{re.escape(suffix)}\.?$"), ""))
        return F.when(key.rlike(java(rf"(?i)[,\s]+(?:{'|'.join(map(re.escape, suffixes))})\.?$")), out).otherwise(key) if suffixes else out

    def kept(key: Column) -> Column:
        if sought is None:
            return fold(cut(key))
        firsts = sorted({re.split("[ ,]", k)[0] for k in sought})
        return F.when(F.substring_index(F.translate(fold(key), ",", " "), " ", 1).isin(*firsts), fold(cut(key))) if firsts else F.lit(None).cast("string")

    return let(F.trim(strip(collapse(x), chars)), kept)


def keyed_digest(key: bytes, x: Column) -> Column:
    """HMAC-SHA256 in hex, composed from two hashes."""
    key = key if len(key) <= 64 else __import__("hashlib").sha256(key).digest()
    inner, outer = (bytes(b ^ pad for b in key.ljust(64, b"\0")) for pad in (0x36, 0x5C))
    first = F.sha2(F.concat(F.lit(inner), x.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def containing_line(text: Column, start: Column, end: Column) -> Column:
    """The line or lines around a span (0-based, half-open)."""
    before = F.substring_index(text.substr(F.lit(1), start), "\n", -1)
    after = F.substring_index(text.substr(end + 1, F.length(text)), "\n", 1)
    return F.concat(before, text.substr(start + 1, end - start), after)


def doc_id_of(x: Column) -> Column:
    return strip(F.regexp_replace(x, "[^A-Za-z0-9_-]+", "_"), "_")


def filename_phrase(path: Column) -> Column:
    """The telling words of a file name, or null."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    words = F.filter(F.split(stem, java(r"[-_\s]+")), lambda w: (w != "") & ~F.lower(w).isin(*V.SAFE_FILENAME_WORDS))
    phrase = normalized(F.array_join(words, " "))
    return F.when(redactable(phrase), phrase)


def capped(label: Column, caps: dict[str, int], default: int = 500) -> Column:
    m = F.create_map(*[F.lit(v) for kv in (caps or {"": 0}).items() for v in kv])
    return F.coalesce(F.element_at(m, label), F.element_at(m, F.lit("_default")), F.lit(default))


def recase(x: Column) -> Column:
    """Words of mostly upper-case text with a capital first letter only; length and other text are kept."""
    letters, upper = F.length(F.regexp_replace(x, r"\P{L}", "")), F.length(F.regexp_replace(x, r"\P{Lu}", ""))
    words = F.transform(F.split(x, r"(?<=[\p{L}\p{Nd}])(?![\p{L}\p{Nd}])|(?<![\p{L}\p{Nd}])(?=[\p{L}\p{Nd}])"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(w.substr(F.lit(2), F.length(w)))))
    return F.when(upper > 0.7 * letters, F.array_join(words, "")).otherwise(x)
