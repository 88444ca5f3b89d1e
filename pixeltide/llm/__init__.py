"""Operators for building language-model training corpora.

Each module holds one operator with a general DataFrame interface; ``queries`` derives the registered result tables
from them.  Nothing outside this subpackage imports it.
"""
