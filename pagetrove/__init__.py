"""Crawled pages to a searchable document table, as Spark jobs."""
