"""The parsers as table functions for SQL: ``FROM files, LATERAL extract_symbols(text)``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="dotted string, name string, kind string, start_line int, end_line int, signature string")
class ExtractSymbols:
    def eval(self, text: str):
        from strata.functions.parse_code import parse_code

        for row in parse_code("", text or "")["symbols"]:
            yield row[4], row[5], row[6], row[7], row[8], row[13]


@udtf(returnType="name string, receiver string, arity int, line int, enclosing string")
class ExtractCalls:
    def eval(self, text: str):
        from strata.functions.parse_code import parse_code

        for name, receiver, _, arity, line, _, enclosing in parse_code("", text or "")["calls"]:
            yield name, receiver, arity, line, enclosing


@udtf(returnType="node_path string, kind string, start_line int, end_line int, summary string, text string")
class DocNodes:
    def eval(self, kind: str, text: str):
        from strata.functions.parse_doc import DocError, parse_doc

        try:
            _, rows = parse_doc(kind, text or "")
        except DocError:
            return
        for row in rows:
            yield row[5], row[6], row[10], row[11], row[12], row[15]


def register(spark: SparkSession) -> None:
    from strata.session import ship

    ship(spark)
    spark.udtf.register("extract_symbols", ExtractSymbols)
    spark.udtf.register("extract_calls", ExtractCalls)
    spark.udtf.register("doc_nodes", DocNodes)
