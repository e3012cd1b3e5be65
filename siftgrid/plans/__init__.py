"""siftgrid.plans"""
