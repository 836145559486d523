"""tilewright.operators"""
