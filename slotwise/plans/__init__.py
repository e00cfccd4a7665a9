"""The reports. Each takes a table source and an explicit ``as_of`` time."""
