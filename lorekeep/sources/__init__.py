"""lorekeep.sources"""
