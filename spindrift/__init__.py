"""Spindrift: a Spark-native engine for multichannel event data and document corpora."""
