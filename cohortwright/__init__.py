"""Cohort preparation, grouped evaluation and evidence ranking as Spark DataFrame operators."""
