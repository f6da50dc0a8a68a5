"""postmill.streaming"""
