"""lodestrata: document-retrieval analytics as PySpark DataFrame plans."""
