"""orbweave: a Spark-first analytics engine for Earth-observation detection and downlink data."""
