"""Spark-native analytics for panel time series, formula expressions and corpora."""
