"""tessella: catalog, document and evaluation analytics expressed as PySpark DataFrame plans."""
