"""tickloom.sources"""
