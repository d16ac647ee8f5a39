"""Operators that prepare training text: ten stages over `documents`, `benchmark`, `labels` and `embeddings`.

Nothing else in the library imports this subpackage.
"""
