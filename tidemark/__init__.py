"""tidemark: Spark-native analytics for time-segmented retrieval-QA corpora."""
