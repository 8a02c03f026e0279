"""The registered queries: importing any of these modules registers all."""

from hirelens.plans import registry, places, files, ingest, parsing, recommending, upkeep  # noqa: F401, I001  (in order of use)
