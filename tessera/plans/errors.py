"""What the compiler raises instead of guessing."""

from __future__ import annotations

#: The categories a refusal falls in.
CATEGORIES = (
    "model_object_parameter",
    "missing_addressing_intent",
    "missing_outer_aggregation",
    "language_gap",
    "type_or_shape_mismatch",
    "unresolved_reference",
    "unsupported_other",
)


class Unsupported(ValueError):
    """A formula or request that has no faithful plan; never answered by a silent value."""

    def __init__(self, category: str, reason: str):
        if category not in CATEGORIES:
            raise ValueError(f"unknown category {category}")
        super().__init__(f"{category}: {reason}")
        self.category, self.reason = category, reason
