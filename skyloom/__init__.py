"""skyloom: Spark-native conjunction screening and corpus preparation."""
