"""stringloom.plans"""
