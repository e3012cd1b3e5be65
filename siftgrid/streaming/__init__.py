"""siftgrid.streaming"""
