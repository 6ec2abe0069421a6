"""Training-data operators: quality, archives, mixing, near-duplicates, personal data, leaks, toxicity, secrets, licences.

Nothing outside this subpackage imports it.
"""
