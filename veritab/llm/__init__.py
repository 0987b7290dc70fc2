"""Operators for preparing training text: one module an operator, all on Spark.

Nothing outside this package imports it, except the guarded entry file and
``corpus_pipeline.py``.
"""
