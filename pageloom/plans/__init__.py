"""pageloom.plans"""
