"""siftgrid.sources"""
