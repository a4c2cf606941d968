"""Spark-native analytics for card-game boards and the logs of decisions made on them."""
