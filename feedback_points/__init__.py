"""Spark jobs that turn free-text survey answers into countable, traceable topics."""
