"""Identity matching, presence and attendance analytics as Spark DataFrame jobs."""
