"""Credit-style analytics and corpus preparation on Apache Spark."""
