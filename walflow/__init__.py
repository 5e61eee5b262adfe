"""Change-data-capture analytics and corpus preparation on Spark."""
