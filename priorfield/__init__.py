"""Event-sequence analytics on Spark: operators are plain DataFrame -> DataFrame functions."""
