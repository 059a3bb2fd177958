"""Incremental forms: resumable n-gram queries and event windows."""
