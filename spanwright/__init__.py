"""spanwright: a PySpark-native analytics engine for code and documentation corpora.

Every operator takes and returns DataFrames.  The core never imports
``spanwright.llm``; that subpackage may be removed without effect on the rest.
"""

__version__ = "0.1.0"
