"""Map and terrain analytics on Spark DataFrames.

Tables of nodes, ways and tags become classified roads, buildings and areas in
local metres; these are assigned to square tiles, turned into faces, and
combined with elevation rasters kept as cell tables.
"""
