"""weirflow: flow analytics on Spark DataFrames.

Programs, event streams and relational lineage are treated as value-flow
graphs; queries over them are DataFrame plans (see README.md).
"""

__version__ = "0.1.0"
ENGINE_ID = "weirflow"
REPORT_SCHEMA = 1
