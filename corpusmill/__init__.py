"""PySpark engine for preparing, auditing and scoring text corpora."""
