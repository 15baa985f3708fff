"""Spark-first analytics over codebase facts: lazy operators, fixed schemas, honest envelopes."""
