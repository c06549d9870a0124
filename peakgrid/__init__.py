"""Spark-native analytics for spectra: cleaning, encoding, distances, clustering and anomaly detection."""
