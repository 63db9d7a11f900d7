"""lorekeep.streaming"""
