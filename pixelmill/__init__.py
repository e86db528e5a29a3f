"""Image-corpus analytics and training-data preparation on Spark."""
