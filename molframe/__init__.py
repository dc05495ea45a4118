"""Molecule-dataset analytics on Spark: typed records, strict schema lock, snapshots, ordered lookup, flat batches."""
