"""Sievelight: data quality, entity resolution and corpus preparation on Spark."""
