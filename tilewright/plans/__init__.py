"""tilewright.plans"""
