"""lorekeep: a Spark-native engine for a knowledge-graph memory."""
