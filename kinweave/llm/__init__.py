"""Operators that prepare text corpora for language-model training.

Nothing outside this subpackage imports it (but for the guarded lookup in
``__spark_entry__.py`` and ``corpus_pipeline.py`` at the top).
"""
