"""Spark-native contact-lead analytics over already-collected posts, comments and pages."""
