"""Systematic-review data processing as Spark jobs: collect, de-duplicate, screen, export."""
