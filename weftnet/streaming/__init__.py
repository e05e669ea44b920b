"""weftnet.streaming"""
