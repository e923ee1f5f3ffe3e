"""pagewatch.streaming"""
