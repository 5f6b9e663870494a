"""Static traffic assignment on Spark DataFrames.

``functions`` holds column expressions, ``sources`` readers and writers,
``operators`` relational and grouped operators over links, demand and flows,
``plans`` solvers and scenario analyses, ``streaming`` demand from event
streams. Links are (scenario_id, arc_id, u, v, capacity, t0), demand is
(scenario_id, o, d, demand); flows carry x beside the link columns.
"""
