"""Spark-native analytics over speech-transcript manifests."""
