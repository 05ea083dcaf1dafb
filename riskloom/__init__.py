"""riskloom: credit-risk feature engineering, evaluation metrics and
financial-text preparation as lazy PySpark DataFrame operators."""

from riskloom.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
