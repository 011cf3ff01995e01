"""Operations of a large-scale training-data pipeline, each as a Spark job."""
