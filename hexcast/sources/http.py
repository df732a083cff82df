"""Python data sources for JSON services that answer for batches of places: once, or polled as a stream."""

from __future__ import annotations

import json
import time
import urllib.request
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class Batch(InputPartition):
    def __init__(self, url: str):
        self.url = url


class JsonHttpSource(DataSource):
    """format("json_http"): option urls is a JSON list of addresses, one for each batch of places.

    Each answer is an object or a list of objects; every object is a row (value string). Failed requests
    are tried again up to `tries` times, waiting `pause` seconds between them.
    """

    @classmethod
    def name(cls) -> str:
        return "json_http"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.urls = json.loads(options["urls"])
        self.tries, self.pause = int(options.get("tries", 5)), float(options.get("pause", 1))

    def partitions(self):
        return [Batch(u) for u in self.urls]

    def read(self, partition):
        for item in items(fetch(partition.url, self.tries, self.pause)):
            yield (json.dumps(item),)


def fetch(url: str, tries: int, pause: float) -> bytes:
    """The body of an answer; failed requests are tried again after a pause."""
    for k in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=60) as answer:
                return answer.read()
        except OSError:
            if k + 1 == tries:
                raise
            time.sleep(pause)


def items(body: bytes) -> list:
    """The objects of an answer, which is one object or a list."""
    found = json.loads(body)
    return found if isinstance(found, list) else [found]


class Turn(InputPartition):
    """One request of a poll: its number since the poll began, and its address."""

    def __init__(self, number: int, url: str):
        self.number, self.url = number, url


class JsonPollSource(DataSource):
    """format("json_poll"), a stream: the addresses are asked one after another, round after round.

    Options: urls (JSON list), store (folder that driver and executors share), every (seconds between two requests, whichever task
    makes them), rounds (0: without end), tries, pause. A row is (request long, value string), an object of an answer.

    The offset is the number of requests made. An answer is stored before its rows are handed on, and a request whose answer
    is stored is not made again: a micro-batch that is replayed after a failure gives the same rows, none lost and none doubled.
    """

    @classmethod
    def name(cls) -> str:
        return "json_poll"

    def schema(self) -> str:
        return "request long, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _PollReader(self.options)


class _PollReader(DataSourceStreamReader):
    def __init__(self, options):
        self.urls, self.store = json.loads(options["urls"]), options["store"].rstrip("/")
        self.every, self.rounds = float(options.get("every", 1)), int(options.get("rounds", 0))
        self.tries, self.pause = int(options.get("tries", 5)), float(options.get("pause", 1))

    def _kept(self, name: str, make) -> bytes:
        """The stored bytes of a name; made and stored whole if there are none."""
        from pyarrow import fs

        files, folder = fs.FileSystem.from_uri(self.store)
        path = f"{folder}/{name}"
        if files.get_file_info(path).type == fs.FileType.NotFound:
            body = make()
            files.create_dir(folder, recursive=True)
            aside = f"{folder}/_{uuid.uuid4().hex}"
            with files.open_output_stream(aside) as out:
                out.write(body)
            files.move(aside, path)
        with files.open_input_stream(path) as file:
            return file.read()

    def initialOffset(self) -> dict:
        return {"requests": 0}

    def latestOffset(self) -> dict:
        began = float(self._kept("began", lambda: str(time.time()).encode()))
        due = len(self.urls) * self.rounds if self.every <= 0 else int((time.time() - began) / self.every) + 1
        return {"requests": min(due, len(self.urls) * self.rounds) if self.rounds else due}

    def partitions(self, start: dict, end: dict):
        return [Turn(k, self.urls[k % len(self.urls)]) for k in range(start["requests"], end["requests"])]

    def read(self, turn: Turn):
        for item in items(self._kept(f"answer-{turn.number}.json", lambda: fetch(turn.url, self.tries, self.pause))):
            yield (turn.number, json.dumps(item))

    def commit(self, end: dict) -> None:
        """Answers stay: the checkpoint may still ask for the last micro-batch again."""


def poll(spark: SparkSession, urls: list[str], store: str, every: float = 1.0, rounds: int = 0) -> DataFrame:
    """The stream of a poll; see JsonPollSource. A poll without a pause needs a number of rounds."""
    if every <= 0 and rounds <= 0:
        raise ValueError("a poll without a pause needs a number of rounds")
    spark.dataSource.register(JsonPollSource)
    return spark.readStream.format("json_poll").options(urls=json.dumps(urls), store=store, every=every, rounds=rounds).load()


def place_urls(base: str, places: list[tuple[float, float]], size: int = 50) -> list[str]:
    """One address for each batch of places (latitude, longitude)."""
    parts = [places[k : k + size] for k in range(0, len(places), size)]
    return [f"{base}&latitude={','.join(str(a) for a, _ in p)}&longitude={','.join(str(o) for _, o in p)}" for p in parts]
