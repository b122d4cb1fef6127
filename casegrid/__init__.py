"""casegrid: Spark jobs and DataFrame operators for clinical-event hotspot analytics."""
