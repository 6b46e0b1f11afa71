"""kiln.functions"""
