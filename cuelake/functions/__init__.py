"""cuelake.functions"""
