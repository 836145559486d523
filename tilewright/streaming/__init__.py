"""tilewright.streaming"""
