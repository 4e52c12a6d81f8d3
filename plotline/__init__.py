"""plotline: property-transaction analytics and text-corpus preparation on PySpark."""
