"""Sources of snapshots and lineage, and sinks of baselines, verdicts and reports."""
