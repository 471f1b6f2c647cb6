"""quakeweave: earthquake relocation and training-data operators on Spark."""
