"""probitas: Spark-native scoring of repeated model answers against a reference truth.

Operators are plain ``DataFrame -> DataFrame`` functions over long tables (one row
per sample, per criterion or per unit); rules and weights are small parameter tables.
"""

__version__ = "0.1.0"
