"""PySpark-native analytics over prediction-market listings from several venues."""
