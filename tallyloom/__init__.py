"""Reconciliation of ledgers, and the data work around it, as Spark plans."""
