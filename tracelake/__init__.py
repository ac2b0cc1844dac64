"""Spark-native analytics of code-flow facts: which service calls which, where data flows, and what reaches a sink."""
