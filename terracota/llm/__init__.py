"""Operators for preparing training text: quality, contamination, secrets, licences, URLs, personal data, tokens, language, near copies."""
