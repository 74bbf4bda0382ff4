"""A PySpark engine for splitting, loading and tracking bulk table extracts."""
