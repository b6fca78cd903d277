"""Privacy-safe queries and privacy jobs over Spark tables and streams."""

from cloakframe.rules import DEFAULT_RULES, Detection, Mask, NameRules, Rules

__all__ = ["DEFAULT_RULES", "Detection", "Mask", "NameRules", "Rules"]
