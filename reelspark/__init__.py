"""reelspark: video-moment retrieval and analytics as Spark DataFrame programs."""
