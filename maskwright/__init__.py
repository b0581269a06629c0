"""Find, score, mask and report sensitive data in Spark tables and streams of text."""
