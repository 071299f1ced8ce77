"""motionlake: robot-demonstration trajectory analytics expressed as Spark DataFrame jobs."""
