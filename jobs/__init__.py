"""Runnable jobs: each has a command line and a JSON file of settings beside it."""
