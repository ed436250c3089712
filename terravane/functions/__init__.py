"""terravane.functions"""
