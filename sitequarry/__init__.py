"""Site indexes from tables of captured web pages, as PySpark jobs."""
