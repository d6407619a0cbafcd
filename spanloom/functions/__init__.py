"""spanloom.functions"""
