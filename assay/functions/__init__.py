from .names import has_evidence, matches, name_kind, normalized_name
from .stats import ratio, rounded, safe_corr
from .text import as_datetime, as_number, clean_number, shorten

__all__ = [
    "as_datetime",
    "as_number",
    "clean_number",
    "has_evidence",
    "matches",
    "name_kind",
    "normalized_name",
    "ratio",
    "rounded",
    "safe_corr",
    "shorten",
]
