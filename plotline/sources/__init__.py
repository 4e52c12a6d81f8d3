"""plotline.sources"""
