"""Operators for preparing training data: one module per operator.

Nothing outside this folder (and ``corpus_pipeline.py`` at the top) imports it.
``queries`` registers one query per operator.
"""
