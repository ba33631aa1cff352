"""Game-record analytics as Spark DataFrame jobs.

Every public function takes DataFrames (or Columns) and returns a DataFrame (or
a Column); nothing runs until the caller asks for rows, except where a result
has to be written once to be numbered or iterated on safely.
"""
