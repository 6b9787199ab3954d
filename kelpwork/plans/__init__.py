"""kelpwork.plans"""
