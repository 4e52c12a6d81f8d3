"""plotline.streaming"""
