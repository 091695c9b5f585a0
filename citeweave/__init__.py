"""citeweave: literature-discovery analytics as lazy Spark plans."""
