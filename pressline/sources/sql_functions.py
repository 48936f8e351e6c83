"""Page reading from SQL: the listing rules of a source as a table function.

    SELECT * FROM listing_anchors(TABLE(list_pages), profile => 'mv')

The function reads the pages where they lie, one row in, any number of rows out; Spark partitions the table. Its columns follow
from the table it is given, so ``analyze`` names them before anything runs.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping
from typing import Any

from pyspark import cloudpickle
from pyspark.errors import PySparkValueError
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from pressline.sources.html_jobs import ANCHORS, finish_links, listing_anchors
from pressline.sources.html_nodes import Page
from pressline.sources.profiles import Profile

# As for the Arrow jobs: executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = "listing_anchors"


def register(spark: SparkSession, profiles: Mapping[str, Profile], name: str = NAME) -> None:
    """Makes the function known to the SQL of a session, for these profiles."""
    chosen = dict(profiles)

    class ListingAnchors:
        @staticmethod
        def analyze(pages: AnalyzeArgument, profile: AnalyzeArgument) -> AnalyzeResult:
            if not pages.isTable or "html" not in pages.dataType.fieldNames():
                raise PySparkValueError(f"{name}: the first argument is a table with a column html")
            if not profile.isConstantExpression or profile.value not in chosen:
                raise PySparkValueError(f"{name}: the profile is one of {', '.join(sorted(chosen))}")
            kept = [field for field in pages.dataType if field.name != "html"]
            return AnalyzeResult(schema=T.StructType([*kept, *ANCHORS]))

        def eval(self, pages: Row, profile: str) -> Iterator[tuple[Any, ...]]:
            if not pages["html"]:
                return
            kept = tuple(value for name, value in zip(pages.__fields__, pages) if name != "html")
            for found in listing_anchors(Page(pages["html"]), chosen[profile]):
                yield (*kept, *(found.get(field) for field in ANCHORS.fieldNames()))

    spark.udtf.register(name, udtf(ListingAnchors))


def links_of(anchors: DataFrame, profile: Profile) -> DataFrame:
    """The links of a source from the rows of the function over its pages, absolute and filtered like those of ``extract_links``."""
    named = anchors.withColumnRenamed("text", "title")
    return finish_links(named.drop("url") if "url" in named.columns else named, {profile.source: profile})
