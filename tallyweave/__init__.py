"""tallyweave: a Spark-native analytics engine for scored sequence data."""
