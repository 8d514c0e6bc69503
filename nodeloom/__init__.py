"""Nodeloom: typing the nodes of a spatial network from long panel data, in Spark."""
