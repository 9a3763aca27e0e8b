"""stringloom.streaming"""
