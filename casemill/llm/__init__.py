"""Training-data operators for large text corpora.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; intermediate tables go to the shared folder that the session names
in ``spark.checkpoint.dir`` (see :mod:`casemill.llm.shared`).
"""
