"""pageloom.streaming"""
