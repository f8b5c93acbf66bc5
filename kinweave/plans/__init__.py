"""kinweave.plans"""
