"""Column -> Column building blocks: URLs, HTML, retry rules, seeded randomness."""
