"""Operators of the problems tagged llm. Nothing else in the package imports this subpackage."""
