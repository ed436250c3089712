"""terravane.sources"""
