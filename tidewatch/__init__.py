"""Scheduled checks over an append-only store of device events, as Spark DataFrame plans."""
