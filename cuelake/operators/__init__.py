"""cuelake.operators"""
