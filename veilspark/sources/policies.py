"""Vocabularies, allowlists and settings from JSON files. They are small and read once, on the driver.

A file that is missing leaves its rules empty; one that is there and malformed stops the run (ValueError).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from pathlib import Path

from ..policy import Policy, allow_key, defined_key, fold

#: fixed values: file names, and the keys of an allowlist entry that hold no names
DEFINED_FILE, STRUCTURAL_FILE, BOILERPLATE_FILE = "contract_defined_terms.json", "structural_patterns.json", "boilerplate.json"
ENTRY_NOTES = ("confirmed_on", "source", "notes")


def _object(path: Path) -> dict:
    if not path.is_file():
        return {}
    try:
        made = json.loads(path.read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise ValueError(f"cannot read {path.name}") from e
    if not isinstance(made, dict):
        raise ValueError(f"{path.name} must hold an object")
    return made


def _strings(values: object) -> list[str]:
    return [v for v in values if isinstance(v, str) and v.strip()] if isinstance(values, list) else []


def read_policy(folder: str | Path | None, allowlist: str | Path | None = None, terms: Iterable[str] = ()) -> Policy:
    """The policy of a folder of vocabularies and an allowlist. Without the folder nothing is ruled out, which is never less safe."""
    blank = Policy(terms=tuple(terms), defined=frozenset(), allowed=frozenset(), boilerplate=(), structural=(), products=())
    root = Path(folder) if folder is not None else None
    if root is None or not root.is_dir():
        return blank
    defined, structural, phrases = (_object(root / f) for f in (DEFINED_FILE, STRUCTURAL_FILE, BOILERPLATE_FILE))
    names = _object(Path(allowlist)) if allowlist is not None else {}
    spans = [i for i in structural.get("suppress_if_span_matches", ()) if isinstance(i, dict) and i.get("name") and i.get("pattern")]
    for item in spans:
        try:
            re.compile(item["pattern"])
        except re.error as e:
            raise ValueError(f"pattern {item['name']} of {STRUCTURAL_FILE} is malformed") from e
    policy = replace(
        blank,
        defined_strip=defined.get("strip_chars", ""), defined_affixes=tuple(defined.get("strip_affixes", ())),
        allow_strip=names.get("strip_chars", ""), allow_suffixes=tuple(names.get("strip_suffixes", ())),
        structural=tuple((i["name"], i["pattern"]) for i in spans),
        boilerplate=tuple(map(fold, _strings(phrases.get("phrases")))),
        products=tuple(map(fold, _strings(structural.get("manufacturer_context_triggers", {}).get("phrases")))),
    )
    listed = [v for entry in names.get("entries", ()) if isinstance(entry, dict) for key, values in entry.items() if key not in ENTRY_NOTES for v in _strings(values)]
    return replace(
        policy,
        defined=frozenset(defined_key(t, policy.defined_strip, policy.defined_affixes) for t in _strings(defined.get("terms"))),
        allowed=frozenset(allow_key(t, policy.allow_strip, policy.allow_suffixes) for t in listed),
    )


@dataclass(frozen=True)
class Region:
    name: str
    category: str
    rect: tuple[float, float, float, float]
    pages: tuple[int, ...] | None = None  # None: all pages

    def __post_init__(self):
        x0, y0, x1, y1 = self.rect
        if not (0 <= x0 < x1 <= 1 and 0 <= y0 < y1 <= 1):
            raise ValueError(f"region {self.name} is not inside the page")


#: name: (type, default, least, most)
NUMBERS = {
    "ocr_dpi": (int, 300, 150, 600),
    "verification_ocr_dpi": (int, 300, 150, 600),
    "barcode_dpi": (int, 120, 72, 300),
    "barcode_max_dimension": (int, 2400, 1200, 6000),
    "min_vector_text_chars": (int, 20, None, None),
    "raster_image_area_ratio": (float, 0.02, None, None),
    "progress_every_pages": (int, 100, None, None),
    "repeated_image_min_pages": (int, 3, None, None),
    "detect_barcodes": (bool, True, None, None),
    "redact_repeated_margin_images": (bool, True, None, None),
}


@dataclass(frozen=True)
class Settings:
    """Numbers by name, model settings and regions."""

    numbers: dict[str, float]
    regions: tuple[Region, ...] = ()
    ner_enabled: bool = False
    ner_labels: tuple[str, ...] = ()
    ner_threshold: float = 0.5
    max_findings: dict[str, int] = field(default_factory=lambda: {"_default": 500})
    retention_days: int = 30

    def __getattr__(self, name: str):
        if name in NUMBERS:
            return self.numbers[name]
        raise AttributeError(name)


def _number(name: str, raw: dict):
    kind, default, least, most = NUMBERS[name]
    try:
        value = kind(raw.get(name, default))
    except (TypeError, ValueError) as e:
        raise ValueError(f"{name} is not a {kind.__name__}") from e
    if least is not None and not least <= value <= most:
        raise ValueError(f"{name} must be from {least} to {most}")
    return value


def read_settings(path: str | Path) -> Settings:
    """Settings of a JSON file, which must exist; values out of their range are errors, disabled regions go."""
    if not Path(path).is_file():
        raise ValueError(f"no settings at {path}")
    raw = _object(Path(path))
    model, limits = raw.get("ner", {}), raw.get("resource_limits", {})
    if not (isinstance(model, dict) and isinstance(limits, dict) and isinstance(model.get("max_findings", {}), dict)):
        raise ValueError("ner, max_findings and resource_limits must be objects")
    try:
        caps = {str(k): int(v) for k, v in model.get("max_findings", {"_default": 500}).items()}
        threshold, days = float(model.get("threshold", 0.5)), int(limits.get("retention_days", 30))
        regions = tuple(
            Region(str(r.get("name", "configured-region")), str(r.get("category", "configured_region")), tuple(map(float, r["rect"])), None if r.get("pages", "all") == "all" else tuple(map(int, r["pages"])))
            for r in raw.get("regions", ()) if r.get("enabled", True)
        )
    except (TypeError, KeyError) as e:
        raise ValueError("malformed settings") from e
    if not (0.05 <= threshold <= 1.0 and all(1 <= c <= 10000 for c in caps.values()) and all(int(v) > 0 for v in limits.values())):
        raise ValueError("model settings or limits are out of range")
    return Settings({n: _number(n, raw) for n in NUMBERS}, regions, bool(model.get("enabled", False)), tuple(_strings(model.get("labels"))), threshold, caps, days)


def regions_frame(spark, settings: Settings):
    """The regions as the small table that region_rects joins."""
    rows = [(r.name, r.category, r.rect, r.pages is None, list(r.pages or ())) for r in settings.regions]
    return spark.createDataFrame(rows, "name string, category string, rect struct<x0:double,y0:double,x1:double,y1:double>, all_pages boolean, pages array<int>")


__all__ = ["NUMBERS", "Region", "Settings", "read_policy", "read_settings", "regions_frame"]
