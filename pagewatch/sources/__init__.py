"""pagewatch.sources"""
