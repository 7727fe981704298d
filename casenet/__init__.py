"""casenet: Spark-native analytics for case-document networks."""
