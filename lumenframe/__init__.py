"""Lumenframe: imaging-session analytics and corpus preparation as Spark dataflows."""
