"""Code-security analytics as Spark jobs: rules, scores, reports, training sets, job streams."""
