"""The engine's operators: profiling, diffing, graph walks, attribution, ruling and history."""
