"""Ingredient sentences as structured data, at DataFrame scale."""

from .operators.amounts import Amount, Composite, Options
from .operators.record import Record, Text
from .plans.parse import SUPPORTED_LANGUAGES, build_records, convert_amounts, inspect, parse, parse_many, register_sql
from .sources.models import Models

__all__ = [
    "SUPPORTED_LANGUAGES", "Amount", "Composite", "Models", "Options", "Record", "Text", "build_records", "convert_amounts", "inspect", "parse", "parse_many", "register_sql",
]
