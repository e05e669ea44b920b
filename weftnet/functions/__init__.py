"""weftnet.functions"""
