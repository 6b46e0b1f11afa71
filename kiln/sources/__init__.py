"""kiln.sources"""
