"""Training-data operators: dedup, tokenising, scans, mixing, language and toxicity models.

Nothing outside this subpackage imports it.
"""
