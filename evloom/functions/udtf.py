"""Table functions: sections of pages as rows of a lateral join, never as one array of a row."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


#: pos and the fields of schemas.SECTION, spelled out: there is no session where analyze() runs.
ROW = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("section_path", T.StringType()), T.StructField("page_number", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("chunk_type", T.StringType()), T.StructField("table_rows", T.ArrayType(T.ArrayType(T.StringType())))])


@udtf
class HtmlSections:
    """html_sections(page): (pos, section_path, page_number, text, chunk_type, table_rows) of each section of a page; none for null and for pages that can't be parsed."""

    @staticmethod
    def analyze(page: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(page.dataType, (T.StringType, T.NullType)):
            raise ValueError("html_sections takes a page's text")
        return AnalyzeResult(ROW)

    def eval(self, page):
        from evloom.operators.html import parse_or_error

        for pos, s in enumerate((parse_or_error(page) or {"sections": []})["sections"]):
            yield pos, s["section_path"], s["page_number"], s["text"], s["chunk_type"], s["table_rows"]


def register(spark: SparkSession) -> None:
    spark.udtf.register("html_sections", HtmlSections)
