"""Operations for large-scale training-data pipelines. Nothing outside imports this package."""
