"""Named queries over the test tables, with their SQL."""

from . import contracts, corpus, dictionary, formats, memory, records, surface, vectors  # noqa: F401
from .catalog import QUERIES, SQL  # noqa: F401
