"""kiln.plans"""
