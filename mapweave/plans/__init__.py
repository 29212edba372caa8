"""Whole flows: import a map, build a terrain world, look at a part of it."""
