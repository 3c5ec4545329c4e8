"""textquarry: document-corpus analytics as PySpark DataFrame plans."""
