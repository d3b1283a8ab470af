"""Operators for preparing training and evaluation text. Nothing outside this package imports it."""
