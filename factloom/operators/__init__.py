"""Set-oriented operators of the engine."""
