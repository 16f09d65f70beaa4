"""Sensitive-text masking and reporting as DataFrame operators."""
