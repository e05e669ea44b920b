"""weftnet.operators"""
