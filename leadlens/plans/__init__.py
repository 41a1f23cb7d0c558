"""Multi-step plans (training, evaluation) and the query catalogue."""
