"""Terrain, rainfall and flood-extent jobs on Spark."""
