"""kelpwork.sources"""
