"""rasterloom.functions"""
