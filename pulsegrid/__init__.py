"""A PySpark engine for windowed metric analytics."""
