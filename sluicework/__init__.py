"""A PySpark-native engine for data cleaning, data quality and training-data preparation."""

from .errors import OutputError, ParseError, SluiceError
from .operators.guard import violations, written_fields
from .operators.profile import json_schema_profile, quality_compare, quality_profile, schema_profile
from .operators.registry import Function, by_salience, extract_tags
from .operators.rules import ExprRule, PyRule, apply_rules, validate
from .plans.generate import Cleaner, Config, apply_module, consolidated, write_module
from .sources.readers import open_dataset

__all__ = [
    "Cleaner", "Config", "ExprRule", "Function", "OutputError", "ParseError", "PyRule", "SluiceError", "apply_module", "apply_rules",
    "by_salience", "consolidated", "extract_tags", "json_schema_profile", "open_dataset", "quality_compare", "quality_profile",
    "schema_profile", "validate", "violations", "write_module", "written_fields",
]
