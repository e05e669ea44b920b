"""weftnet.sources"""
