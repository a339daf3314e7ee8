"""Particle analytics and stepping as Spark DataFrame plans."""
