"""stringloom.operators"""
