"""pagemill: page extraction and crawl analytics as Spark jobs."""
