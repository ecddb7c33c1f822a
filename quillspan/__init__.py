"""A Spark-first analytics engine for news-to-asset attribution and corpus preparation."""
