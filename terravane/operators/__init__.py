"""terravane.operators"""
