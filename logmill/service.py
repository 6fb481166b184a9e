"""The engine at work: streaming ingest and retention as settings say."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from .config import Config
from .jsonlog import to_stderr
from .operators import auth, logs, retention
from .operators.aggregate import aggregate
from .session import within
from .sources import ingest
from .streaming.ingest import drain, ingest_stream, stalled


@dataclass
class Service:
    """A running engine: its stream, its janitor, and what clients may ask."""

    spark: SparkSession
    config: Config
    query: StreamingQuery
    janitor: retention.Janitor

    @classmethod
    def start(cls, spark: SparkSession, source: str, config: Config) -> Service:
        """Ingest what arrives in source, and sweep old days at once and from then on now and then."""
        to_stderr(config.log_level)
        query = ingest_stream(spark, source, config.logs_path, config.rejected_path, config.checkpoint_path, files=config.files_per_batch, every=f"{config.batch_seconds} seconds", available_now=False)
        janitor = retention.Janitor(lambda: retention.retain(spark, config.logs_path, config.retention_days, datetime.now(UTC)), config.retention_seconds)
        if config.retention_enabled:
            janitor.run()
            janitor.start()
        return cls(spark, config, query, janitor)

    def healthy(self) -> bool:
        return self.query.isActive and not stalled(self.query, self.config.stall_seconds)

    def _answer(self, keys, headers: Mapping[str, str], run):
        if self.config.auth_enabled:
            auth.authorise(self.spark, keys, headers, "query")
        return within(self.spark, self.config.query_seconds, run)

    def page(self, params, keys=None, headers: Mapping[str, str] | None = None) -> dict:
        """{"logs": [...], "next_cursor": ...} of a request's parameters."""
        return self._answer(keys, headers or {}, lambda: logs.page(ingest.read_logs(self.spark, self.config.logs_path), params))

    def buckets(self, params, keys=None, headers: Mapping[str, str] | None = None) -> dict:
        """{"buckets": [...]} of a request's parameters; MAX_BUCKETS bounds what a group has."""
        return self._answer(keys, headers or {}, lambda: {"buckets": [r.asDict() for r in aggregate(ingest.read_logs(self.spark, self.config.logs_path), params).collect()]})

    def stop(self, timeout: float = 10.0) -> bool:
        """Work off what has arrived and end; False if that took too long."""
        self.janitor.stop()
        return drain(self.query, timeout)
