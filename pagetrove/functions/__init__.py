"""Column expressions: text cleaning, HTML fields, URLs, search patterns."""
