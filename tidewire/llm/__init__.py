"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it, apart from the guarded import in
``__spark_entry__.py`` and from ``corpus_pipeline.py``, which belongs to it.
"""
