"""stringloom.sources"""
