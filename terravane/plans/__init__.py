"""terravane.plans"""
