"""postmill: a Spark-native engine for job-posting analytics and training-data preparation."""

__version__ = "0.1.0"
