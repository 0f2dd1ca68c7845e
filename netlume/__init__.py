"""Spark-native analytics for network telemetry: windows, detectors, rules, rate control and enrichment."""
