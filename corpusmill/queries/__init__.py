from . import corpus, duplicates, pages, reports, text, vectors  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
