"""Relational operators over page, record and crawl tables."""
