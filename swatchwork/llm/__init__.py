"""Training-data operators: scoring, filtering, de-duplicating, mixing and formatting text tables with Spark."""
