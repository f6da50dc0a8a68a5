"""postmill.operators"""
