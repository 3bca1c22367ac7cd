"""A data-reliability engine on Spark: profiles, diffs, drift, renames, schema merges, Merkle commitments, governance."""
