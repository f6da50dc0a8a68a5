"""postmill.sources"""
