"""Chat providers behind one signature, called from partitions with retries; an offline provider for tests."""

from __future__ import annotations

import json
import os
import random
import re
import time
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

Provider = Callable[[list[dict]], tuple[str, dict]]


class TemporaryFailure(Exception):
    """Too many requests, a server's error or a broken connection: worth another try."""


def setting(name: str, file: str = "~/.env") -> str:
    """An environment variable, else a NAME=value line of a file."""
    if name in os.environ:
        return os.environ[name]
    path = os.path.expanduser(file)
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                k, eq, v = line.strip().partition("=")
                if eq and k.strip() == name:
                    return v.strip().strip("\"'")
    raise KeyError(name)


def events(lines: Iterable[str]) -> Iterator[str]:
    """The data of each event of a server-sent event stream: `data` lines up to a blank line, joined; comments and other fields are passed over."""
    held: list[str] = []
    for line in lines:
        field, _, value = line.rstrip("\r\n").partition(":")
        if field == "data":
            held.append(value.removeprefix(" "))
        elif not field and not value and held:
            yield "\n".join(held)
            held = []
    if held:
        yield "\n".join(held)


@dataclass
class Reply:
    """What a stream of chat deltas has said so far."""

    text: list[str] = field(default_factory=list)
    usage: dict = field(default_factory=dict)
    ended: bool = False

    def take(self, data: str) -> None:
        self.ended = self.ended or data.strip() == "[DONE]"
        if self.ended:
            return
        event = json.loads(data)
        self.usage.update(event.get("usage") or {})
        for choice in event.get("choices", ()) or ():
            self.text.append(str((choice.get("delta") or {"content": ""}).get("content") or ""))

    def result(self) -> tuple[str, dict]:
        return "".join(self.text).strip(), self.usage


def read_stream(lines: Iterable[str]) -> tuple[str, dict]:
    """Text and usage of a stream of chat deltas."""
    reply = Reply()
    for data in events(lines):
        reply.take(data)
    return reply.result()


@dataclass(frozen=True)
class Retry:
    """How a call is made again: so many calls, waits that grow from `first` by `factor` up to `most` and vary by a share of `jitter`."""

    calls: int = 5
    first: float = 2.0
    factor: float = 3.0
    most: float = 60.0
    jitter: float = 0.25
    sleep: Callable[[float], None] = time.sleep
    chance: Callable[[], float] = random.random

    def waits(self) -> Iterator[float]:
        for n in range(self.calls - 1):
            yield min(self.most, self.first * self.factor**n) * (1 + self.jitter * (2 * self.chance() - 1))

    def ask(self, provider: Provider, messages: list[dict]) -> tuple[str, dict]:
        """The first answer that is not empty. A broken one counts as a temporary failure; after the last call the failure is raised."""
        waits = self.waits()
        while True:
            try:
                text, usage = provider(messages)
                if text:
                    return text, usage
                failure: Exception = TemporaryFailure("the answer is empty")
            except (TemporaryFailure, ValueError, KeyError) as e:
                failure = e
            wait = next(waits, None)
            if wait is None:
                raise failure
            self.sleep(wait)


def http_provider(url: str, key: str, model: str, max_tokens: int = 16000, timeout: float = 600, effort: str | None = None) -> Provider:
    """An OpenAI-style chat endpoint, streamed."""

    def ask(messages: list[dict]) -> tuple[str, dict]:
        import urllib.error
        import urllib.request

        body = {"model": model, "max_tokens": max_tokens, "messages": messages, "stream": True, "stream_options": {"include_usage": True}}
        if effort:
            body["reasoning_effort"] = effort
        req = urllib.request.Request(f"{url}/chat/completions", json.dumps(body).encode(), {"Authorization": f"Bearer {key}", "Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(req, timeout=timeout) as r:
                return read_stream(x.decode("utf-8") for x in r)
        except urllib.error.HTTPError as e:
            if e.code == 429 or e.code >= 500:
                raise TemporaryFailure(str(e.code)) from e
            raise
        except OSError as e:
            raise TemporaryFailure(str(e)) from e

    return ask


def offline_provider(words: Iterable[str]) -> Provider:
    """Answers with the prompt's last line, without the words that are not listed: deterministic, needs no network."""
    known = set(words)

    def ask(messages: list[dict]) -> tuple[str, dict]:
        last = messages[-1]["content"].rsplit("\n", 1)[-1]
        out = " ".join(w for w in last.split() if w.strip(".,?!").lower() in known) or "it"
        return out, {"in": sum(len(m["content"].split()) for m in messages), "out": len(out.split()), "think": 0, "cached": 0}

    return ask


@dataclass
class Rewriter:
    """Asks for a text's rewrite, checks it against the lists, and asks again with the words that are not on them named."""

    provider: Provider
    words: frozenset[str]
    names: frozenset[str]
    system: str
    limit: float
    attempts: int
    retry: Retry

    def off_list(self, text: str) -> tuple[list[str], float]:
        found = re.findall("[A-Za-z]+", text)
        bad = [w for w in found if w not in (self.words if w.islower() else self.names if w == w.capitalize() else ())]
        return bad, len(bad) / max(len(found), 1)

    def run(self, text: str) -> tuple:
        talk = [{"role": "system", "content": self.system}, {"role": "user", "content": text}]
        used: Counter = Counter()
        rates: list[float] = []
        while True:
            answer, usage = self.retry.ask(self.provider, talk)
            used.update({k: int(v) for k, v in usage.items()})
            bad, rate = self.off_list(answer)
            rates.append(rate)
            if rate <= self.limit or len(rates) >= self.attempts:
                return answer, len(rates), rate, bad, len(answer) / max(len(text), 1), dict(used), rates[0], rate <= self.limit
            named = "; ".join(dict.fromkeys(bad))
            talk = [*talk, {"role": "assistant", "content": answer}, {"role": "user", "content": f"Say this without these words: {named}"}]


def rewrite(chunks: DataFrame, provider: Provider, words: list[str], names: list[str], system: str, limit: float = 0.03, attempts: int = 2, parallel: int = 16, retry: Retry = Retry()) -> DataFrame:
    """chunks(chunk_id, text) to answers that are checked and, above the limit of off-list words, asked once more.

    Runs inside partitions, up to `parallel` calls at a time, so calls that were made are not made again when only the connection fails; rows keep their order.
    """
    import pandas as pd

    one = Rewriter(provider, frozenset(words), frozenset(names), system, limit, attempts, retry)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(parallel) as pool:
            for f in frames:
                rows = [(c, *r) for c, r in zip(f["chunk_id"], pool.map(one.run, f["text"].fillna("")))]
                yield pd.DataFrame(rows, columns=["chunk_id", "answer", "attempts", "oov_rate", "bad", "len_ratio", "usage", "first_oov", "accepted"])

    schema = "chunk_id string, answer string, attempts int, oov_rate double, bad array<string>, len_ratio double, usage map<string, bigint>, first_oov double, accepted boolean"
    return chunks.select("chunk_id", "text").mapInPandas(run, schema)
