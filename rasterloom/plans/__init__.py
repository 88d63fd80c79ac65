"""rasterloom.plans"""
