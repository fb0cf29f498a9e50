"""Operators for preparing training data. Nothing else in configlens imports this subpackage."""
