"""Composed plans: dashboard views, the scoring job and the upload run."""
