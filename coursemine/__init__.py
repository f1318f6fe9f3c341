"""Course-corpus analytics as Spark DataFrame jobs."""
