"""kindred: relation-aware vector analytics as lazy Spark plans."""
