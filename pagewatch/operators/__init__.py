"""pagewatch.operators"""
