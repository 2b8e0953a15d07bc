"""Thresholds and word lists of triage and routing as data: defaults here, and a rules file that overrides them.

The file is YAML, or JSON where no YAML library is installed. Sections and names that are missing keep their defaults;
others are ignored, so one file can serve several programs.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

# Words of each domain, in the order that decides between equals.
DOMAINS = {
    "financial": ["revenue", "profit", "balance sheet", "income statement", "dividend", "fiscal year", "net income", "assets", "liabilities", "equity", "cash flow", "audit", "expenditure", "financial statement", "total income", "total expense", "net profit", "birr", "etb", "annual report", "bank", "deposit", "loan", "capital", "reserve"],
    "legal": ["plaintiff", "defendant", "court", "statute", "jurisdiction", "contract", "hereby", "pursuant", "arbitration", "indemnity", "clause", "regulation", "compliance"],
    "technical": ["algorithm", "implementation", "architecture", "system design", "module", "protocol", "specification", "throughput", "latency", "benchmark", "deployment", "vulnerability", "assessment", "evaluation", "methodology", "framework", "performance indicator", "transparency", "accountability", "procurement", "sector analysis", "survey findings", "pharmaceutical", "manufacturing"],
    "medical": ["patient", "diagnosis", "treatment", "clinical", "symptom", "prescription", "dosage", "pathology", "prognosis", "therapy", "pharmaceutical"],
}


@dataclass(frozen=True)
class Rules:
    # Fixed values.
    sample_pages: int = 5
    domain_pages: int = 2
    native_density: float = 0.001
    scanned_share: float = 0.7
    table_share: float = 0.3
    figure_share: float = 0.25
    figure_density: float = 0.005
    column_variation: float = 0.25
    column_words: int = 10
    fast_text_least: float = 0.6
    layout_least: float = 0.5
    ocr_least: float = 0.4
    max_depth: int = 4
    review_below: float = 0.4
    max_image_share: float = 0.5
    budget: float = 0.5
    vision: bool = False
    domains: dict[str, list[str]] = field(default_factory=lambda: DOMAINS)

    def least(self, strategy: str) -> float:
        return {"fast_text": self.fast_text_least, "layout_aware": self.layout_least, "ocr_heavy": self.ocr_least}.get(strategy, 0.0)


#: Where a rules file has the values: section and name.
PLACES = {
    "sample_pages": ("origin_detection", "max_pages_to_sample"),
    "native_density": ("origin_detection", "min_char_density"),
    "scanned_share": ("origin_detection", "scanned_image_ratio"),
    "table_share": ("layout_detection", "table_area_ratio_threshold"),
    "figure_share": ("layout_detection", "figure_ratio_threshold"),
    "figure_density": ("layout_detection", "figure_char_density_min"),
    "column_variation": ("layout_detection", "column_variance_threshold"),
    "fast_text_least": ("escalation", "strategy_a_min_confidence"),
    "layout_least": ("escalation", "strategy_b_min_confidence"),
    "ocr_least": ("escalation", "strategy_c_min_confidence"),
    "max_depth": ("escalation", "max_escalation_depth"),
    "review_below": ("review", "flag_confidence_below"),
    "max_image_share": ("review", "max_image_ratio_fast_text"),
    "budget": ("budget", "max_per_document"),
    "vision": ("budget", "enable_vision"),
}


def load(path: str) -> Rules:
    """The rules of a file, defaults for what it leaves out. Raises ValueError for a file that holds no mapping."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml

        data = yaml.safe_load(text)
    except ImportError:
        data = json.loads(text)
    if not isinstance(data, dict):
        raise ValueError(f"no rules in {path}")
    kinds = {f.name: f.type for f in fields(Rules)}
    cast = {"int": int, "float": float, "bool": bool}
    given = {}
    for name, (section, key) in PLACES.items():
        value = (data.get(section) or {}).get(key)
        if value is not None:
            given[name] = cast[str(kinds[name])](value)
    words = data.get("domain_keywords")
    if words:
        given["domains"] = {str(d): [str(w).lower() for w in ws or []] for d, ws in words.items()}
    return replace(Rules(), **given)
