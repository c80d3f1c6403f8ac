"""Cluster-scheduling analytics expressed as Spark DataFrame jobs."""
