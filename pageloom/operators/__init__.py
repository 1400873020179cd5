"""pageloom.operators"""
