"""PySpark engine for token-budgeted document compression and corpus preparation."""
