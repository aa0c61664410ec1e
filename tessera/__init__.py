"""tessera: a PySpark-native engine for particle-trajectory analysis and spline-basis force matching."""
