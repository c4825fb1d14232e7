"""Operators for building language-model training corpora.

One module per operator; ``queries.py`` registers one query per operator and
``stages.py`` holds the functions of the corpus pipeline.  Nothing outside this
subpackage imports it.
"""
