"""gristmill: a Spark-native SQL analytics engine."""
