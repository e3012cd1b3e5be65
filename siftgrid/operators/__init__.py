"""siftgrid.operators"""
