"""Settings of a run: a frozen value that plans and worker functions close over."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Flags:
    debug: bool = False
    max_analysis_depth: int = 10
    max_file_size: int = 1 << 30
    max_compression_ratio: int = 100
    mime_provider_order: tuple[str, ...] = ("native", "extension")
    mime_timeout: float = 2.0
    network_policy: str = "passive"
    yara_rules_dir: str | None = None
    vt_api_key: str | None = None
    cache_path: str | None = None
    default_verbosity: int = 0
    default_format: str = "text"
    defang: bool = False
    max_lookups: int = 10

    def to_dict(self) -> dict:
        return asdict(self)

    def update(self, values: dict) -> Flags:
        """A copy with the values of known names; others are ignored."""
        known = {f.name for f in fields(self)}
        return replace(self, **{k: v for k, v in values.items() if k in known})

    @classmethod
    def from_dict(cls, values: dict) -> Flags:
        return cls().update(values)

    @classmethod
    def from_session(cls, spark: SparkSession) -> Flags:
        """Defaults overlaid by the session's settings `triage.<name>`."""
        found = {}
        for f in fields(cls):
            text = spark.conf.get(f"triage.{f.name}", None)
            if text is not None:
                default = getattr(cls(), f.name)
                if isinstance(default, bool):
                    found[f.name] = text.lower() == "true"
                elif isinstance(default, tuple):
                    found[f.name] = tuple(x.strip() for x in text.split(","))
                else:
                    found[f.name] = type(default)(text) if default is not None else text
        return cls().update(found)
