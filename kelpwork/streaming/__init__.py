"""kelpwork.streaming"""
