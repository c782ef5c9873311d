"""Spark-native table operators for corporate-credit analytics and corpus work."""
