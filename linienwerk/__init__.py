"""Transit analytics and training-data preparation as PySpark DataFrame operators."""
