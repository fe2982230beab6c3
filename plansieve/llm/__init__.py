"""Operators for preparing large text corpora.

Nothing else in the library imports this subpackage; it imports only Spark,
Arrow, NumPy and, where an operator names it, a tokenizer or an automaton
library.
"""
