"""kelpwork.functions"""
