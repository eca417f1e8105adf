"""sievework: a PySpark engine that reads tables of web pages and selects from them."""
