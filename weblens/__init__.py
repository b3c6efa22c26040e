"""Web-crawl analytics as Spark jobs: tables and streams in, DataFrames out."""
