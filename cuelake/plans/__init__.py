"""cuelake.plans: composite plans over several operators."""
