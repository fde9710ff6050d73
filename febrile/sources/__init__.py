"""Inputs: CSV ingest, region-keyed stores and test-table fixtures."""
