"""The library's functions for SQL: chunks(text, kind), html_text(html), mail_text(html), python_structure(source), entity_records(answer); and as table
functions chunk_rows(TABLE(SELECT key, text, kind ...)) and structure_rows(TABLE(SELECT key, source ...)), which give rows, not arrays."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.operators import chunk, extract
from tessera.session import ship

CHUNKS = "array<struct<chunk_id:int,chunk_text:string,start_char:int,end_char:int>>"
ENTITIES = "array<struct<name:string,type:string,description:string,ordinals:string>>"
STRUCTURE = "array<struct<kind:string,name:string,edge_type:string,target:string,line:int>>"


class ChunkRows:
    """Rows (key, chunk_id, chunk_text, start_char, end_char) of a table's rows (key, text, kind); a null text has none, a null kind is text."""

    def eval(self, row):
        if row[1] is not None:
            for n, (t, a, b) in enumerate(chunk.chunks_of(row[1], row[2] or "text")):
                yield str(row[0]), n, t, a, b


class StructureRows:
    """Rows (key, kind, name, edge_type, target, line) of a table's rows (key, source): what Python sources define, import and call."""

    def eval(self, row):
        for r in extract.python_structure(row[1] or ""):
            yield (str(row[0]), *r)


def register(spark: SparkSession) -> SparkSession:
    """Makes them known to spark.sql(); arrays are read with inline() or explode(), that of entity_records() from a subquery."""
    ship(spark)

    def vectorised(one, kind: str):
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(one)

        return F.pandas_udf(run, kind)

    def chunks(rows: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, kinds in rows:
            yield pd.Series([[{"chunk_id": n, "chunk_text": t, "start_char": a, "end_char": b} for n, (t, a, b) in enumerate(chunk.chunks_of(text, kind))] for text, kind in zip(texts, kinds)])

    spark.udtf.register("chunk_rows", F.udtf(ChunkRows, returnType="key string, chunk_id int, chunk_text string, start_char int, end_char int"))
    spark.udtf.register("structure_rows", F.udtf(StructureRows, returnType="key string, kind string, name string, edge_type string, target string, line int"))
    names = ("kind", "name", "edge_type", "target", "line")
    spark.udf.register("chunks", F.pandas_udf(chunks, CHUNKS))
    spark.udf.register("html_text", vectorised(lambda t: None if t is None else chunk.html_text(t), "string"))
    spark.udf.register("mail_text", vectorised(lambda t: None if t is None else chunk.mail_text(t), "string"))
    spark.udf.register("python_structure", vectorised(lambda t: [dict(zip(names, r)) for r in extract.python_structure(t or "")], STRUCTURE))
    # The record parser is made of built-in functions, so it is a SQL function of them: extract.entity_array() written as SQL.
    spark.sql(rf"""CREATE OR REPLACE TEMPORARY FUNCTION entity_records(answer STRING) RETURNS {ENTITIES} RETURN
        transform(filter(transform(split(answer, '{extract.RECORD}'), r -> transform(
            split(regexp_replace(regexp_replace(regexp_replace(r, r'^\s+|\s+$', ''), r'^\(', ''), r'\)$', ''), r'<\|>'),
            (x, i) -> regexp_replace(regexp_replace(x, r'^\s+|\s+$', ''), if(i = 0, '^"+|"+$', 'a^'), ''))),
            f -> f[0] = 'entity' AND size(f) >= 4), f -> named_struct('name', f[1], 'type', f[2], 'description', f[3], 'ordinals', get(f, 4)))""")
    return spark
