"""Spark-first analytics over semi-structured lending disclosures.

Sub-packages: ``functions`` (scalar Column expressions), ``operators``
(relational operators), ``sources`` (scans, extraction, sinks), ``plans``
(whole queries), ``streaming`` (incremental jobs).  ``llm`` holds
training-data operators and is optional: nothing here imports it.
"""
