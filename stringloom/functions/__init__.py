"""stringloom.functions"""
