"""lorekeep.operators"""
