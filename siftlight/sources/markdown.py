"""Documents and a query from a markdown file.

Headings part the file: one that starts with "quer" in any case opens the query, any
other the documents; lines before a heading are documents. A line starting with ``<!--``
opens a comment up to a line with ``-->``. One bullet or number before a line goes.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MARK = re.compile(r"(?:[-*+] |\d+\. )")


def parse(text: str) -> tuple[list[str], str | None]:
    """The documents, and the first line of the query."""
    documents: list[str] = []
    query = None
    in_query = in_comment = False
    for line in map(str.strip, text.splitlines()):
        if in_comment:
            in_comment = "-->" not in line
        elif line.startswith("<!--"):
            in_comment = "-->" not in line
        elif line.startswith("#"):
            in_query = line.lstrip("#").strip().lower().startswith("quer")
        elif line:
            mark = _MARK.match(line)
            line = line[mark.end() :].strip() if mark else line
            if not in_query:
                documents.append(line)
            elif query is None:
                query = line
    return documents, query


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, kind, ordinal, text) of the documents and queries of whole files."""
    return parse_texts(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value")))


def parse_texts(texts: DataFrame, id_col: str = "path", text_col: str = "value") -> DataFrame:
    """(id_col, kind, ordinal, text) of the documents and queries of whole texts."""
    import pyarrow as pa

    key = texts.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                documents, query = parse(text or "")
                rows += [(name, "document", i, t) for i, t in enumerate(documents)]
                rows += [(name, "query", 0, query)] if query is not None else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=[id_col, "kind", "ordinal", "text"])

    return texts.select(id_col, text_col).mapInArrow(run, f"{id_col} {key}, kind string, ordinal long, text string")


def write(rows: DataFrame, path: str, text: str = "text", order: tuple[str, ...] = ("ordinal",)) -> None:
    """A markdown file of bullets, one document each, with white space flattened, in order
    of the columns ``order``. It is one file, so one task sorts and writes it."""
    from siftlight.functions.text import collapse

    head = rows.sparkSession.createDataFrame([(0, "# Documents"), (1, "")], "head int, value string")
    lines = rows.select(F.concat(F.lit("- "), collapse(F.col(text))).alias("value"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    keys = [F.coalesce("head", F.lit(2)), *(f"o{i}" for i in range(len(order))), "value"]
    every = head.unionByName(lines, allowMissingColumns=True)
    every.coalesce(1).sortWithinPartitions(*keys).select("value").write.mode("overwrite").text(path)
