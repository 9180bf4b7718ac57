"""Thermocline: tiered tables on Spark.

One logical table is made of a hot row store, a cold snapshot lake and a keyed
overlay of corrections, joined at a movable cut-line.  ``thermocline.engine.Engine``
is the entry point; the operators can also be used on plain DataFrames.
"""

__version__ = "0.1.0"
