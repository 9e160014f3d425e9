"""Document screening on Spark: text repair, extraction, matching and ranking as DataFrame plans."""
