"""kiln.operators"""
