"""Record codification and corpus preparation on PySpark."""
