"""Proofline: evidence audits of technical documentation as Spark DataFrame jobs."""
