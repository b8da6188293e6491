"""evalmill: curation of labelled sample manifests and evaluation of binary rankers as Spark jobs."""
