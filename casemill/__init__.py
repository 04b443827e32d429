"""Intake analytics on Spark: rules, evidence, journals, review queues and their evaluation."""
