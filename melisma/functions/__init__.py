"""Column functions: each takes and returns Columns, and stays in the JVM."""

from . import arrays, dates, maps, maths, strings

__all__ = ["arrays", "dates", "maps", "maths", "strings"]
