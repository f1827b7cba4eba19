"""Building-scan and floor-plan analytics as Spark DataFrame operators."""
