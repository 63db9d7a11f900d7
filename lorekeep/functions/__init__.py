"""lorekeep.functions"""
