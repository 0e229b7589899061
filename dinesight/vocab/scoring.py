"""Scoring constants (fixed values)."""

from __future__ import annotations

# severity -> (rank, caution threshold, clean-evidence floor, default cross-contact level)
SEVERITY = {
    "avoid_preference": (0, 0.38, 0.05, "not_concerned"),
    "intolerance": (1, 0.28, 0.08, "moderate"),
    "allergy": (2, 0.18, 0.12, "moderate"),
    "anaphylaxis": (3, 0.10, 0.20, "strict"),
}
# cross-contact level -> (warning floor, other-nut bump)
CROSS_CONTACT = {"not_concerned": (0.0, 0.0), "moderate": (0.35, 0.03), "strict": (0.45, 0.07)}
OTHER_NUT_CEILING = 0.50
COVERAGE_FULL, COVERAGE_DISCOUNT = 20, 0.22
PERVASIVE_SHARE = 0.6
NAV_BASE, NAV_SLOPE, NAV_SUSPECTED_SLOPE = 0.22, 0.55, 0.25
NAV_CHART_FACTOR, NAV_INFERRED_RETAIN, NAV_HANDLING_FACTOR = 0.7, 0.7, 0.85
SUSPECTED_BASE, SUSPECTED_CONFIDENCE_CAP = 0.18, 0.4
TIER_RANK = {"likely_ok": 0, "caution": 1, "avoid": 2}
GROUNDED_BASES = ["allergen_matrix", "menu_evidence"]
MODEL_UPWARD_BAND = 0.20
LABELED_SHARE = 0.6
# allergen -> cuisine baselines; "_default" applies to any other cuisine
GENERIC_DEFAULT = 0.15
GENERIC_BASELINES = {
    "milk": {"_default": 0.30, "italian": 0.55, "french": 0.55, "indian": 0.50, "american": 0.45},
    "gluten": {"_default": 0.45, "italian": 0.75, "chinese": 0.55, "american": 0.60, "japanese": 0.55},
}
VERDICT_RANK = {"good_options": 3, "limited": 2, "unknown": 1, "not_compatible": 0}
BASIS_RANK = {"labeled": 4, "ai_assessed": 3, "mixed": 2, "estimated": 1, "none": 0}
