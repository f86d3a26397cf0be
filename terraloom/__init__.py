"""terraloom: Spark-native anomaly analytics over geospatial observation tables."""
