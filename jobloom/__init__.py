"""Analytics over job postings, and operators that prepare training data, on PySpark."""
