"""febrile: outbreak-risk analytics on Spark.

Batch scoring (two-stage classification), region-keyed stores kept by
set-based merge upserts, place resolution against a candidate table and
the derived dashboard views, all expressed as DataFrame plans.
"""

__version__ = "0.1.0"
