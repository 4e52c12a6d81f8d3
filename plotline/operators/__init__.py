"""plotline.operators"""
