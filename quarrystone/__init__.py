"""Evidence retrieval and data preparation over filings, as Spark DataFrame plans."""
