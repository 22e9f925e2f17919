"""Sequence quantification and large-table analytics as PySpark DataFrame programs."""
