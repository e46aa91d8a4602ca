"""recollect: a PySpark engine for retrieving and maintaining large memory stores."""
