"""Reading map files and storing tiled tables."""
