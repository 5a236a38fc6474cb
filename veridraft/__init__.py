"""Spark-native document-audit analytics.

Every public operator takes and returns DataFrames. See README.md for the map
from capabilities to modules.
"""

__version__ = "0.1.0"
