"""Evidence-grounded fact analytics, declared as lazy Spark DataFrame transforms."""
