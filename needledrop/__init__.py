"""needledrop: catalogue analytics and corpus preparation as Spark DataFrame jobs."""
