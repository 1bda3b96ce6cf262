"""textloom: text-quality, dictionary and corpus analytics on Spark."""
