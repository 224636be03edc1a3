"""cuelake.catalog"""
