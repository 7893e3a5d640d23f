"""Harvestry: Spark operators that turn captured pages, JSON documents and
recognised tables into governed, de-duplicated records."""
