"""Evidence-aware terrain, contour and line analytics as Spark DataFrame jobs."""
