"""Column builders for expressions whose meaning differs from Spark's defaults."""

from .expressions import add, as_text, code_points, contains_text, divide, lenient_cast, like_percent, modulo, multiply, subtract

__all__ = ["add", "as_text", "code_points", "contains_text", "divide", "lenient_cast", "like_percent", "modulo", "multiply", "subtract"]
