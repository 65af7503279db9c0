"""Evidence-oriented retrieval and analytics on Spark."""
