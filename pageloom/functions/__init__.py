"""pageloom.functions"""
