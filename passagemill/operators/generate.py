"""Text generation as a DataFrame operator: a pluggable client, retries, one client per Arrow batch stream."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import GeneratorConfig


class GenerationError(RuntimeError):
    """The generator refused or stayed unreachable."""


@dataclass(frozen=True)
class Reply:
    status: int
    body: str


#: Takes a JSON payload, gives a reply; raises OSError if it can't reach the generator.
Client = Callable[[str], Reply]


def backoff(attempt: int, limited: bool, config: GeneratorConfig) -> float:
    return min(config.backoff_base * config.backoff_factor ** (attempt - 1) * (config.backoff_limited if limited else 1.0), config.backoff_cap)


def request(client: Client, payload: str, config: GeneratorConfig, sleep: Callable[[float], None] = time.sleep) -> Reply:
    """A reply of status 2xx; what may pass is tried again, what may not fails at once."""
    for attempt in range(1, config.max_retries + 1):
        limited = False
        try:
            reply = client(payload)
            if 200 <= reply.status < 300:
                return reply
            limited = reply.status == 429
            if not limited and not 500 <= reply.status < 600:
                raise GenerationError(f"HTTP {reply.status}: {reply.body[:300]}")
            said = f"HTTP {reply.status}"
        except OSError as e:
            said = str(e)
        if attempt == config.max_retries:
            raise GenerationError(f"{said} after {attempt} attempts")
        sleep(backoff(attempt, limited, config))
    raise GenerationError("no attempts")


def _posted(address: str, payload: str, headers: dict[str, str], timeout: float):
    """An open response; errors of the server are replies too."""
    import urllib.error
    import urllib.request

    asked = urllib.request.Request(address, payload.encode(), {"Content-Type": "application/json", **headers})
    try:
        return urllib.request.urlopen(asked, timeout=timeout)
    except urllib.error.HTTPError as e:
        return e


def http_client(config: GeneratorConfig, key: str, headers: dict[str, str] | None = None) -> Callable[[], Client]:
    """Makes clients that post to the configured address."""

    def make() -> Client:
        def post(payload: str) -> Reply:
            with _posted(config.base_url, payload, {"Authorization": f"Bearer {key}", **(headers or {})}, config.timeout) as r:
                return Reply(r.status, r.read().decode(errors="replace"))

        return post

    return make


def content_client(config: GeneratorConfig, key: str) -> Callable[[], Client]:
    """Makes clients of the contents-and-instruction form: the model is named in the address, the key in a header."""

    def make() -> Client:
        def post(payload: str) -> Reply:
            address = f"{config.base_url.rstrip('/')}/models/{config.model}:generateContent"
            with _posted(address, payload, {"x-goog-api-key": key}, config.timeout) as r:
                return Reply(r.status, r.read().decode(errors="replace"))

        return post

    return make


#: Takes a JSON payload, gives the status and the lines of a reply as they come; raises OSError as a client does.
StreamClient = Callable[[str], tuple[int, Iterator[str]]]


def stream_client(config: GeneratorConfig, key: str, headers: dict[str, str] | None = None) -> StreamClient:
    """A client whose replies come in server-sent lines."""

    def lines(response) -> Iterator[str]:
        with response:
            for line in response:
                yield line.decode(errors="replace").rstrip("\r\n")

    def post(payload: str) -> tuple[int, Iterator[str]]:
        response = _posted(config.base_url, payload, {"Authorization": f"Bearer {key}", "Accept": "text/event-stream", **(headers or {})}, config.timeout)
        return response.status, lines(response)

    return post


def delta(line: str) -> str | None:
    """What a line adds to the answer: nothing if it is no data, or no JSON of the expected form."""
    try:
        return json.loads(line[5:])["choices"][0]["delta"].get("content") or None if line.startswith("data:") else None
    except (ValueError, LookupError, AttributeError, TypeError):
        return None


def stream(client: StreamClient, payload: str, config: GeneratorConfig, sleep: Callable[[float], None] = time.sleep) -> Iterator[str]:
    """The pieces of an answer as they come, up to the end mark. What may pass is tried again from the start, pieces that
    were given before it broke are then given again; what may not fails at once."""
    asked = json.dumps({**json.loads(payload), "stream": True})
    for attempt in range(1, config.max_retries + 1):
        limited = False
        try:
            status, lines = client(asked)
            if 200 <= status < 300:
                for line in lines:
                    if line.startswith("data:") and line[5:].strip() == "[DONE]":
                        return
                    if piece := delta(line):
                        yield piece
                return
            limited = status == 429
            said = f"HTTP {status}"
            if not limited and not 500 <= status < 600:
                raise GenerationError(f"{said}: {''.join(lines)[:300]}")
        except OSError as e:
            said = str(e)
        if attempt == config.max_retries:
            raise GenerationError(f"{said} after {attempt} attempts")
        sleep(backoff(attempt, limited, config))


def echo_client() -> Client:
    """Answers with the payload's size, for tests."""
    return lambda payload: Reply(200, json.dumps({"choices": [{"message": {"content": f" {len(payload)} characters "}}]}))


def generate(rows: DataFrame, make: Callable[[], Client], config: GeneratorConfig | None = None, payload: str = "payload") -> DataFrame:
    """The columns, and ``body`` or ``error`` of the reply to each payload."""
    config = config or GeneratorConfig()
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make()
        for batch in batches:
            bodies, errors = [], []
            for said in batch[payload].to_pylist():
                try:
                    bodies.append(request(client, said, config).body)
                    errors.append(None)
                except GenerationError as e:
                    bodies.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bodies, pa.string()), pa.array(errors, pa.string())], [*names, "body", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, body string, error string")
