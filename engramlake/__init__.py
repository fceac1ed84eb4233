"""Associative graph memory analytics on PySpark.

Everything is a DataFrame in, DataFrame out.  The subpackages are
``functions`` (Column expressions), ``operators`` (DataFrame operators),
``plans`` (multi-step recall, encoding and maintenance), ``sources`` (readers and
sinks) and ``streaming``.  ``llm`` is optional: nothing here imports it.
"""
