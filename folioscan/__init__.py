"""Spark-native engine for mining collections of scholarly documents."""
