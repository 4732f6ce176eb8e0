"""Restaurant-chain analytics as plain DataFrame functions on Apache Spark."""
