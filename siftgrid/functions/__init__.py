"""siftgrid.functions"""
