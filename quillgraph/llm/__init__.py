"""Operators for preparing language-model training corpora. Nothing else in the package imports these modules."""
