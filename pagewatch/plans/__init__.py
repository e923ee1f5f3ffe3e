"""pagewatch.plans"""
