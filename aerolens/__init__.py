"""Air-quality analytics as Spark DataFrame operators.

Every public operator takes and returns DataFrames (or Columns), so a job is a
chain of ``df.transform(op, ...)`` calls that Catalyst plans as one query.
"""
