"""Column functions that Catalyst can optimise."""
