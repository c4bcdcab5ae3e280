"""Text-sentiment analytics on Spark DataFrames.

Every operator takes DataFrames and returns DataFrames (or Columns). A corpus is
``(doc_id BIGINT, label STRING, tokens ARRAY<STRING>)`` with labels ``pos`` / ``neg``.
"""
