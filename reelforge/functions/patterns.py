"""Patterns that users write, judged by the engine that runs them."""

from __future__ import annotations

from pyspark.errors import IllegalArgumentException
from pyspark.sql import SparkSession


def compiles(pattern: str) -> bool:
    """Whether the JVM's regular expressions, which rlike() uses, take the pattern; asked once per pattern, on the driver."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True
