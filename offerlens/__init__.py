"""Offer and rating analytics expressed as Spark DataFrame plans."""
