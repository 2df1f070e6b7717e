"""Store-camera analytics as Spark DataFrame functions."""
