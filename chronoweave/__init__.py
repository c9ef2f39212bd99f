"""Timeline analytics on Spark: month-interval algebra, gap finding, lineage, scoring and evaluation."""
