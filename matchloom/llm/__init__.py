"""Operators for preparing language-model training corpora. Nothing outside this folder imports it."""
