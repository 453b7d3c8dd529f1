"""Relational operators over sensor relations."""
