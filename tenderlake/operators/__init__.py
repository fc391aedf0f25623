"""DataFrame-to-DataFrame building blocks: merges, roll-ups, joins, resolution."""
