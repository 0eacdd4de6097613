"""Training-data operators for large corpora (optional sub-package)."""
