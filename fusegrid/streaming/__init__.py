"""Keyed state: one set of state classes, driven by a batch fold or by a streaming query."""
