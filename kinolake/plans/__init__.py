"""User-level pipelines composed of operators."""
