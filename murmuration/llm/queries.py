"""All registered queries of this package: importing this module fills ``QUERIES`` and ``ORACLES``."""

from murmuration.llm import native_queries, python_queries, vector_queries  # noqa: F401
from murmuration.llm.common import ORACLES, QUERIES  # noqa: F401
