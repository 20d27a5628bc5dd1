"""Textwerk: a Spark-native engine for labelled text corpora and their association statistics."""
