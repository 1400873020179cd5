"""pageloom: Spark-native layout analytics and corpus preparation."""
