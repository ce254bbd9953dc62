"""Relational operators, ordered folds and image kernels."""
