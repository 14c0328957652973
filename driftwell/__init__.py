"""driftwell: Spark-native analytics over spatio-temporal sensor data."""
