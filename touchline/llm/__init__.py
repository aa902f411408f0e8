"""Training-data operators: mixing, dedup, tokenisation, classification, media, privacy and URL rules.

Self-contained: nothing outside this subpackage imports it.
"""
