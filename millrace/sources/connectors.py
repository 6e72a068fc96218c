"""Connectors to services: they need packages on Spark's class path, or services, that may not be there.

Each fails with ``ConnectorUnavailable`` and says what it lacks.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.errors import ConnectorUnavailable
from millrace.schema import FieldList, apply_fields, column
from millrace.sources.base import Source, Target, flattened, nested
from millrace.sources.csv import CSVSource
from millrace.sources.resources import open_resource


def _loaded(make, what: str) -> Any:
    try:
        return make()
    except Exception as e:
        if "DATA_SOURCE_NOT_FOUND" in str(e) or "ClassNotFound" in str(e) or isinstance(e, ImportError):
            raise ConnectorUnavailable(f"{what} is not available: {str(e).splitlines()[0]}") from e
        raise


class XLSSource(Source):
    """A sheet, by number or name, of a workbook; the header is its first row after ``skip_rows``."""

    def __init__(self, resource: Any, sheet: int | str | None = None, encoding: str | None = None, skip_rows: int | None = None, read_header: bool = True, fields=None):
        self.resource, self.sheet, self.encoding, self.skip_rows, self.read_header, self.fields = resource, sheet, encoding, skip_rows, read_header, fields

    def read(self, spark: SparkSession) -> DataFrame:
        def load():
            import pandas as pd

            handle, close = open_resource(self.resource, "rb")
            try:
                return pd.read_excel(handle, sheet_name=self.sheet or 0, skiprows=self.skip_rows or 0, header=0 if self.read_header else None)
            finally:
                if close:
                    handle.close()

        frame = _loaded(load, "a reader of workbooks")
        if self.fields is not None:
            frame.columns = FieldList(self.fields).names()
        frame.columns = [str(c) for c in frame.columns]
        df = spark.createDataFrame(frame)
        return apply_fields(df, FieldList(self.fields)) if self.fields is not None else df


class _Remote(Source):
    format, package = "", ""

    def options(self) -> dict:
        return {}

    def __init__(self, fields=None, expand: bool = False):
        self.fields, self.expand = fields, expand

    def read(self, spark: SparkSession) -> DataFrame:
        df = _loaded(lambda: spark.read.format(self.format).options(**self.options()).load(), self.package)
        df = flattened(df, self.expand)
        return df.select(*(column(df, n) for n in FieldList(self.fields).names())) if self.fields is not None else df


class MongoSource(_Remote):
    """A collection; the fields that are asked for are pushed to the server."""

    format, package = "mongodb", "the MongoDB connector for Spark"

    def __init__(self, collection: str, database: str, host: str = "localhost", port: int = 27017, expand: bool = False, fields=None):
        super().__init__(fields, expand)
        self.collection, self.database, self.host, self.port = collection, database, host, port

    def options(self) -> dict:
        return {"connection.uri": f"mongodb://{self.host}:{self.port}", "database": self.database, "collection": self.collection}


class MongoTarget(Target):
    def __init__(self, collection: str, database: str, host: str = "localhost", port: int = 27017, truncate: bool = False, expand: bool = False):
        self.source, self.truncate, self.expand = MongoSource(collection, database, host, port), truncate, expand

    def write(self, df: DataFrame) -> None:
        writer = nested(df, self.expand).write.format("mongodb").options(**self.source.options()).mode("overwrite" if self.truncate else "append")
        _loaded(writer.save, MongoSource.package)


class ElasticsearchSource(_Remote):
    """All documents of an index."""

    format, package = "org.elasticsearch.spark.sql", "the Elasticsearch connector for Spark"

    def __init__(self, document_type: str, database: str = "test", host: str = "localhost", port: int | str = 9200, expand: bool = False, fields=None):
        super().__init__(fields, expand)
        self.document_type, self.database, self.host, self.port = document_type, database, host, port

    def options(self) -> dict:
        return {"es.nodes": self.host, "es.port": str(self.port), "es.resource": f"{self.database}/{self.document_type}"}


class ElasticsearchTarget(Target):
    """Documents of an index, with ids from ``id`` or ``_id`` if there is such a field."""

    def __init__(self, document_type: str, database: str = "test", host: str = "localhost", port: int | str = 9200, truncate: bool = False, expand: bool = False, create: bool = False, replace: bool = False):
        self.source, self.expand, self.overwrite = ElasticsearchSource(document_type, database, host, port), expand, truncate or (create and replace)

    def write(self, df: DataFrame) -> None:
        key = next((k for k in ("id", "_id") if k in df.columns), None)
        options = self.source.options() | ({"es.mapping.id": key} if key else {})
        writer = nested(df, self.expand).write.format("org.elasticsearch.spark.sql").options(**options).mode("overwrite" if self.overwrite else "append")
        _loaded(writer.save, ElasticsearchSource.package)


class GoogleSpreadsheetSource(Source):
    """A published sheet, by key or name, through its address as CSV. The service that took user names is gone."""

    def __init__(self, spreadsheet_key: str | None = None, spreadsheet_name: str | None = None, worksheet_id: str | None = None, worksheet_name: str | None = None, query_string: str | None = None, username: str | None = None, password: str | None = None, fields=None):
        self.key, self.name, self.worksheet_id, self.worksheet_name, self.query, self.fields = spreadsheet_key, spreadsheet_name, worksheet_id, worksheet_name, query_string, fields

    def read(self, spark: SparkSession) -> DataFrame:
        if not self.key:
            raise ConnectorUnavailable("sheets can be read by key only; lookup by name needs a service that was retired")
        url = f"https://docs.google.com/spreadsheets/d/{self.key}/export?format=csv" + (f"&gid={self.worksheet_id}" if self.worksheet_id else "")
        df = CSVSource(url, fields=self.fields).read(spark)
        return df.filter(F.expr(self.query)) if self.query else df


class ScraperWikiSource(Source):
    """The service is gone; reading raises."""

    def __init__(self, scraper: str):
        self.scraper = scraper

    def read(self, spark: SparkSession) -> DataFrame:
        raise ConnectorUnavailable("the service was shut down; read its exports with a CSV source")
