"""terravane.streaming"""
