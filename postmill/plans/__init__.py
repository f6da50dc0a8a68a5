"""postmill.plans"""
