"""Raw answers of bibliographic providers as a Spark data source: spark.read.format("lucidex_providers").

Options: endpoint, an address with {provider} and {doi} (http, https or file);
dois, a JSON list, or dois_path, a text file with one DOI a line that every
executor can read; providers, a comma list (all by default); batch, DOIs a
partition; retries and pause (seconds, doubled with each try).

Each partition asks one provider for one batch of DOIs, so a lost executor
repeats its batches only.  Providers are chosen by the option: a filter that
Spark pushed into a Python source would stay with it and narrow other uses of
the same DataFrame, so none is pushed.  An answer that says there is no such work is a row without a
body; one that fails after all tries is a row with its error.
"""

from __future__ import annotations

import json
import sys
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PROVIDERS = ("crossref", "openalex", "pubmed", "hal", "arxiv")
SCHEMA = "doi string, provider string, body string, error string"
TIMEOUT = 30


class Batch(InputPartition):
    def __init__(self, provider: str, dois: list[str]):
        self.provider, self.dois = provider, dois


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.providers = [p.strip() for p in options.get("providers", ",".join(PROVIDERS)).split(",") if p.strip()]
        if unknown := sorted(set(self.providers) - set(PROVIDERS)):
            raise ValueError(f"unknown providers: {', '.join(unknown)}")

    def _dois(self) -> list[str]:
        if "dois" in self.options:
            found = json.loads(self.options["dois"])
        else:
            with urllib.request.urlopen(self.options["dois_path"], timeout=TIMEOUT) as f:  # noqa: S310
                found = f.read().decode().splitlines()
        return list(dict.fromkeys(d.strip() for d in found if d and d.strip()))

    def partitions(self) -> list[Batch]:
        size, dois = int(self.options.get("batch", 100)), self._dois()
        return [Batch(p, dois[i : i + size]) for p in self.providers for i in range(0, len(dois), size)]

    def read(self, partition: Batch | None) -> Iterator[tuple]:
        if partition is None:
            return
        for doi in partition.dois:
            yield doi, partition.provider, *self._ask(partition.provider, doi)

    def _ask(self, provider: str, doi: str) -> tuple[str | None, str | None]:
        address = self.options["endpoint"].format(provider=provider, doi=urllib.parse.quote(doi, safe=""))
        pause, error = float(self.options.get("pause", 1)), None
        for left in range(int(self.options.get("retries", 3)), -1, -1):
            try:
                with urllib.request.urlopen(address, timeout=TIMEOUT) as answer:  # noqa: S310
                    return answer.read().decode("utf-8", "replace"), None
            except urllib.error.HTTPError as e:
                if e.code in (404, 410):
                    return None, None
                error = f"HTTP {e.code}"
                if e.code < 500 and e.code != 429:
                    break
            except OSError as e:
                if isinstance(getattr(e, "reason", e), FileNotFoundError):
                    return None, None
                error = f"{type(e).__name__}: {e}"
            if left:
                time.sleep(pause)
                pause *= 2
        return None, error


class Providers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lucidex_providers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        if "endpoint" not in self.options or not {"dois", "dois_path"} & set(self.options):
            raise ValueError("the options endpoint and dois or dois_path are needed")
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to the session."""
    spark.dataSource.register(Providers)


# The source travels inside the tasks, so workers need not import this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
