"""Reconciliation of one base table with any number of reference tables, as Spark jobs."""
