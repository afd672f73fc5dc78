"""Financial-table analytics on Spark: semi-structured report text to typed facts, retrieval and answers."""
