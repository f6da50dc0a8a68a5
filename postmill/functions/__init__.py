"""postmill.functions"""
