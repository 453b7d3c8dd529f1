"""Readers, decoders, sinks and the test relations."""
