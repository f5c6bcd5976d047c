"""tesserae: a Spark-first engine for analytical queries and for SQL catalogs as data."""
