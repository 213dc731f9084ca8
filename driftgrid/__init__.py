"""driftgrid: moving-object analytics on Spark (trajectories, windows, spatial range queries)."""
