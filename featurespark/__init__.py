"""featurespark: a Spark-native engine for map feature layers.

Layers are Parquet tables (attributes plus an optional WKB geometry column)
under a root URI. The public entry point is :class:`Layers`.
"""

from featurespark.errors import LayerQueryError
from featurespark.session import query_session
from featurespark.sources.catalog import Layers

__all__ = ["Layers", "LayerQueryError", "query_session"]
