"""Folioscope: document analytics and training-data operators on PySpark."""
