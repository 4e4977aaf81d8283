"""Operators that prepare language-model training corpora."""
