"""tickloom.streaming"""
