"""Plan-level helpers: shared tables and connected components."""
