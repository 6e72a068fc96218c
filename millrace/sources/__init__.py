"""Sources and targets: where tables come from and go to."""

from millrace.sources.auditor import StreamAuditor
from millrace.sources.connectors import (
    ElasticsearchSource,
    ElasticsearchTarget,
    GoogleSpreadsheetSource,
    MongoSource,
    MongoTarget,
    ScraperWikiSource,
    XLSSource,
)
from millrace.sources.csv import CSVSource, CSVTarget
from millrace.sources.files import FileSource, FileTarget, infer_fields
from millrace.sources.memory import GeneratorSource, RecordListSource, RowListSource
from millrace.sources.resources import open_resource
from millrace.sources.sql import SQLSource, SQLTarget
from millrace.sources.text import FormattedPrinter, HTMLTarget, PrettyPrinter
from millrace.sources.yaml import YamlDirectorySource, YamlDirectoryTarget

__all__ = [
    "CSVSource",
    "CSVTarget",
    "ElasticsearchSource",
    "ElasticsearchTarget",
    "FileSource",
    "FileTarget",
    "FormattedPrinter",
    "GeneratorSource",
    "GoogleSpreadsheetSource",
    "HTMLTarget",
    "MongoSource",
    "MongoTarget",
    "PrettyPrinter",
    "RecordListSource",
    "RowListSource",
    "SQLSource",
    "SQLTarget",
    "ScraperWikiSource",
    "StreamAuditor",
    "XLSSource",
    "YamlDirectorySource",
    "YamlDirectoryTarget",
    "infer_fields",
    "open_resource",
]
