"""Set-oriented multilingual retrieval and corpus preparation on PySpark."""
