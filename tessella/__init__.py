"""A PySpark engine for document retrieval and table analytics."""
