"""Intentionally empty: the modelled system has no unbounded input (a run is a batch of steps)."""
