"""plotline.functions"""
