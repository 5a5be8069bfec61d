"""Scene analytics and text-corpus operators as plain PySpark DataFrame functions."""
