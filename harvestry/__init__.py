"""A Spark-first engine for capturing, enriching and delivering personal reading queues."""
