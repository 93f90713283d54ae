"""The lexical index that the registered queries share: built once for a table folder and session, read by every query."""

from __future__ import annotations

from ..operators.kept import kept, root
from ..operators.lexical import LexicalIndex, bm25
from ..sources import corpus

_BUILT: dict[tuple, LexicalIndex] = {}


def _state(spark, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(at).getModificationTime(), fs.getContentSummary(at).getLength()


def lexical_index(spark, d: str) -> LexicalIndex:
    """The index of the pages of a table folder. It is built anew where the table's file has changed."""
    key = spark.sparkContext.applicationId, d, _state(spark, f"{d}/documents.parquet")
    if key not in _BUILT:
        _BUILT[key] = LexicalIndex.create(corpus.pages(spark, d), f"{root(spark)}/lexical")
    return _BUILT[key]


def best_pages(spark, d: str, queries=None, **how):
    """The hits of the benchmark's (or other) queries, for plans that go on with them: written, so that they are found once."""
    return kept(bm25(lexical_index(spark, d), corpus.queries(spark, d) if queries is None else queries, **how))
