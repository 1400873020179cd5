"""pageloom.sources"""
