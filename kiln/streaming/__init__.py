"""kiln.streaming"""
