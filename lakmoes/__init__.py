"""Find and mask personal data in published documents, and prepare document corpora, on Spark."""
