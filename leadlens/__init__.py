"""leadlens: lead scoring and lead analytics as Spark DataFrame jobs.

Sub-packages
------------
sources    readers/writers, the deterministic lead view, model persistence
functions  column expressions (features, scorecard, bands, message text)
operators  DataFrame -> DataFrame operators (filters, preprocessing, split,
           metrics, explanations, profile and management aggregates)
plans      multi-step plans (training, evaluation bundle) and the query catalogue
streaming  the same scoring functions over Structured Streaming sources
"""

__version__ = "0.1.0"
