"""Multi-step pipelines composed from the operators."""
