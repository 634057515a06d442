"""Named queries over the driver's tables, each with the SQL that must give the same rows."""

from .core import REGISTRY  # noqa: F401
from . import annotation_queries, image_queries, model_queries, source_queries  # noqa: F401,E402
