"""Plan-level helpers: sessions, scratch tables, iterative plans."""
