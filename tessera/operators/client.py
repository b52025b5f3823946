"""A client of a chat-completions service that gives JSON objects, with repair, shortening and backoff.

The service is any that speaks the common chat-completions format over HTTP.  The client is picklable: it
is sent to the executors with the prompts (see ``enrichment.ask``), holds no connection and logs nothing
by itself; what happened in each attempt goes to ``record``, if there is one, and into the error.  ``enrichment.ask`` records
the attempts of every prompt and writes them beside its answer.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, fields

from ..functions.jsonrepair import parse_object

# Names and defaults of the service's settings, and of the environment variables, which are
# ``PREFIX`` and the name in capitals.
PREFIX = "OPENROUTER_"
TEXT_MARK = "\nText:\n"
# Characters of a malformed answer that go into the prompt to correct it, and what a shortened text keeps at least.
SHOWN, KEPT = 6000, 1000


@dataclass(frozen=True)
class ServiceSettings:
    """Where and how to ask."""

    url: str = "https://openrouter.ai/api/v1/chat/completions"
    model: str = "openai/gpt-4o-mini"
    api_key: str | None = None
    temperature: float = 0.0
    max_tokens: int = 10000
    timeout: int = 90
    retries: int = 3
    site_url: str | None = None
    app_name: str = "tessera"
    repair_json: bool = True
    retry_shorter_input: bool = True
    continue_on_error: bool = True
    workers: int = 12

    @classmethod
    def from_environment(cls, environment: Mapping[str, str] = os.environ) -> ServiceSettings:
        """The defaults, overridden by environment variables; numbers and truth values are read by the defaults' types."""
        found = {}
        for f in fields(cls):
            value = environment.get(PREFIX + f.name.upper())
            if value is not None:
                kind = type(f.default)
                found[f.name] = value.casefold() == "true" if kind is bool else value if f.default is None else kind(value)
        if "workers" in found:
            found["workers"] = max(1, found["workers"])
        return cls(**found)


def read_dotenv(text: str) -> dict[str, str]:
    """The ``NAME=value`` lines of a file of environment variables; comments and other lines are passed over."""
    pairs = (line.split("=", 1) for line in map(str.strip, text.splitlines()) if "=" in line and not line.startswith("#"))
    return {name.strip(): value.strip().strip('"').strip("'") for name, value in pairs}


class ServiceError(RuntimeError):
    """No attempt gave an answer; ``attempts`` says what became of each."""

    def __init__(self, attempts: list[dict]):
        super().__init__(f"no answer after {len(attempts)} attempts: {attempts[-1]['error'] if attempts else 'none allowed'}")
        self.attempts = attempts

    def __reduce__(self):
        return type(self), (self.attempts,)


#: Sends (url, headers, payload, timeout) and gives the response's JSON.
Transport = Callable[[str, dict, dict, int], dict]


def post(url: str, headers: dict, payload: dict, timeout: int) -> dict:
    request = urllib.request.Request(url, json.dumps(payload).encode("utf-8"), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as response:  # noqa: S310 - the URL is a setting
        return json.load(response)


def shortened(prompt: str) -> str:
    """The prompt with half of its text (of the whole, if it marks no text), KEPT characters at least."""
    head, mark, text = prompt.rpartition(TEXT_MARK) if prompt.count(TEXT_MARK) == 1 else ("", "", prompt)
    return head + mark + text[: max(KEPT, len(text) // 2)]


class ServiceClient:
    """Asks for JSON objects; see ``enrichment.Client``."""

    def __init__(self, settings: ServiceSettings | None = None, transport: Transport = post, record: Callable[[dict], None] | None = None, sleep: Callable[[float], None] = time.sleep):
        self.settings = settings or ServiceSettings.from_environment()
        if not self.settings.api_key:
            raise RuntimeError(f"{PREFIX}API_KEY is not set")
        self.transport, self.record, self.sleep = transport, record, sleep

    def recording(self, record: Callable[[dict], None]) -> ServiceClient:
        """The same client with another recorder of its attempts."""
        return ServiceClient(self.settings, self.transport, record, self.sleep)

    def prompts(self, prompt: str, answers: list[str]) -> Iterator[str]:
        """What to ask in each attempt; ``answers`` holds the malformed answers so far.

        The second attempt shows a malformed answer to be corrected, the last one asks with a shorter text.
        """
        last = self.settings.retries - 1
        for attempt in range(self.settings.retries):
            if attempt == 1 and answers:
                yield f"{prompt}\n\nWhat you said last could not be read as JSON; it follows. Say it again as one valid JSON object, without any other text.\n{answers[-1][:SHOWN]}"
            elif attempt == last and attempt and self.settings.retry_shorter_input:
                yield shortened(prompt)
            else:
                yield prompt

    def payload(self, system: str, prompt: str, schema_hint: str | None) -> dict:
        told = system + (f"\n\nShape of the JSON object:\n{schema_hint}" if schema_hint else "")
        return {
            "model": self.settings.model, "temperature": self.settings.temperature, "max_tokens": self.settings.max_tokens,
            "messages": [{"role": "system", "content": told}, {"role": "user", "content": prompt}], "response_format": {"type": "json_object"},
        }

    def chat_json(self, system: str, user: str, schema_hint: str | None = None) -> dict:
        """The JSON object that the service answers with.  ServiceError if no attempt gives one."""
        s = self.settings
        headers = {"Authorization": f"Bearer {s.api_key}", "X-Title": s.app_name} | ({"HTTP-Referer": s.site_url} if s.site_url else {})
        tried: list[dict] = []
        malformed: list[str] = []
        for prompt in self.prompts(user, malformed):
            told = {"attempt": len(tried) + 1, "model": s.model, "status": "success", "finish_reason": None, "usage": None, "error": None, "content": ""}
            try:
                response = self.transport(s.url, headers, self.payload(system, prompt, schema_hint), s.timeout)
                choice = response["choices"][0]
                content = str(choice["message"]["content"])
                told |= {"finish_reason": choice.get("finish_reason"), "usage": response.get("usage")}
                try:
                    if told["finish_reason"] == "length":
                        raise ValueError("the answer is cut off at the limit of tokens")
                    return parse_object(content, s.repair_json)
                except ValueError as e:
                    malformed.append(content)
                    told |= {"status": "truncated" if told["finish_reason"] == "length" else "malformed", "error": str(e), "content": content}
            except Exception as e:  # noqa: BLE001 - whatever goes wrong on the way is a failed attempt
                told |= {"status": failure(e), "error": f"{type(e).__name__}: {e}"}
            finally:
                tried.append(told)
                if self.record:
                    self.record(told)
            self.sleep(min(2 ** (len(tried) - 1), 8))
        raise ServiceError(tried)


def failure(error: Exception) -> str:
    if isinstance(error, TimeoutError) or "timed out" in str(error):
        return "timeout"
    return "http" if isinstance(error, urllib.error.HTTPError) else "request"
