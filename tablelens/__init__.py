"""tablelens: profile one table of unknown shape and compute a fixed
catalogue of analytics on it as Spark DataFrame jobs.

Entry points: ``tablelens.plans.report.dashboard`` (profile + KPIs + charts
+ insights), ``tablelens.plans.profile.build_profile`` and the operator
modules under ``tablelens.operators``.
"""

__version__ = "0.1.0"
