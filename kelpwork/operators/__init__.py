"""kelpwork.operators"""
