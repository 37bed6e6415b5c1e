"""Spark-native extraction of flat tables from captured web content."""
