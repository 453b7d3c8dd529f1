"""fusegrid: causal sensor-fusion analytics as Spark plans."""

__version__ = "0.1.0"
