"""Spark-native analytics for keypoint pose sequences and other frame-ordered tables."""
