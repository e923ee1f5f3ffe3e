"""pagewatch.functions"""
