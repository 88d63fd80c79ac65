"""rasterloom.sources"""
