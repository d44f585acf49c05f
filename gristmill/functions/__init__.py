"""Scalar functions as Column helpers: built-in expressions, with the semantics Spark does not share added."""

from gristmill.functions import dates, jsons, logic, numbers, strings

__all__ = ["dates", "jsons", "logic", "numbers", "strings"]
