"""PySpark jobs that turn captured hierarchical publications into a section-level corpus."""
