"""A model behind an OpenAI-compatible endpoint, as annotator and narrator.

Not used by any tested result: it needs a server.  ``post`` is any function
from a URL and a JSON body to status and text, so its behaviour is tested
without one.
"""

from __future__ import annotations

import hashlib
import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable, MutableMapping
from concurrent.futures import ThreadPoolExecutor

from ..config import CLINICAL_TASKS, DATA_REGIMES, MODEL_FAMILIES, TAXONOMY
from ..operators.annotate import room_left
from ..schemas import ANNOTATION

Post = Callable[[str, dict | None], tuple[int, str]]
INSTRUCTION = "Describe the paper as one JSON object with the fields of the schema. Use only what title, abstract and keywords say. JSON only."

LABELLING = "Give the paper every label of the list that its title, abstract and keywords bear out, or none, as one JSON object with the list \"subfields\". JSON only."


def http_post(url: str, body: dict | None, timeout: float = 600) -> tuple[int, str]:
    headers = {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get('MODEL_API_KEY', '')}"}
    request = urllib.request.Request(url, json.dumps(body).encode() if body is not None else None, headers)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")


def json_schema() -> dict:
    """The annotation as a JSON schema, with its closed vocabularies."""
    enums = {"clinical_task": CLINICAL_TASKS, "data_regime": DATA_REGIMES}
    kinds = {"array": lambda n: {"type": "array", "items": {"type": "string"} | ({"enum": list(MODEL_FAMILIES)} if n == "model_family" else {})}, "integer": lambda n: {"type": ["integer", "null"]}, "boolean": lambda n: {"type": "boolean"}, "string": lambda n: {"type": "string"} | ({"enum": list(enums[n])} if n in enums else {})}
    return {"type": "object", "properties": {n: kinds[k](n) for n, k in ANNOTATION.items()}, "required": [n for n in ANNOTATION if n != "sample_size"]}


def label_schema(labels: tuple[str, ...]) -> dict:
    return {"type": "object", "properties": {"subfields": {"type": "array", "items": {"type": "string", "enum": list(labels)}}}, "required": ["subfields"]}


def streamed(text: str) -> str:
    """The answer in a stream of events: the pieces of all its ``data:`` lines."""
    said = [json.loads(x[5:]) for x in text.splitlines() if x.startswith("data:") and x[5:].strip() not in ("", "[DONE]")]
    return "".join((c.get("delta") or {}).get("content") or "" for x in said for c in x.get("choices") or [])


def second_model(post: Post | None = None) -> ModelServer | None:
    """Another model for a report of its own, if the environment names its address and itself."""
    url, name = os.environ.get("SECOND_MODEL_URL"), os.environ.get("SECOND_MODEL_NAME")
    return ModelServer(url, name, post or http_post, int(os.environ.get("SECOND_MODEL_MAX_TOKENS", "8192"))) if url and name else None


class ModelServer:
    """``known`` keeps answers by what was asked, such as a dictionary on the driver; in tasks, answers are kept in a ``CacheTable``."""

    def __init__(self, base_url: str, model: str, post: Post = http_post, max_tokens: int = 1536, concurrency: int = 8, guided: bool = True, temperature: float = 0.0, labels: tuple[str, ...] = tuple(TAXONOMY), known: MutableMapping[str, str] | None = None):
        self.base_url, self.name, self.post = base_url.rstrip("/"), model, post
        self.max_tokens, self.concurrency, self.guided, self.temperature = max_tokens, concurrency, guided, temperature
        self.labels, self.known = labels, known

    @property
    def signature(self) -> str:
        """All that an answer depends on besides the paper."""
        return json.dumps({"model": self.name, "max_tokens": self.max_tokens, "temperature": self.temperature, "guided": self.guided, "instruction": INSTRUCTION, "schema": json_schema(), "labels": list(self.labels)}, sort_keys=True)

    def chat(self, messages: list[dict], schema: dict | None = None, max_tokens: int | None = None, temperature: float | None = None, stream: bool = False, force: bool = False) -> str:
        """One answer; if the answer wanted does not fit, once more with what does.

        A long answer is better streamed: the time limit then holds from piece
        to piece.  An answer that is known is not asked for again, unless forced.
        """
        body = {"model": self.name, "messages": messages, "temperature": self.temperature if temperature is None else temperature, "max_tokens": max_tokens or self.max_tokens}
        if schema is not None and self.guided:
            body["guided_json"] = schema
        key = hashlib.sha256(json.dumps([body, schema], sort_keys=True, ensure_ascii=False).encode()).hexdigest()
        if self.known is not None and not force and key in self.known:
            return self.known[key]
        if stream:
            body["stream"] = True
        status, text = self.post(f"{self.base_url}/chat/completions", body)
        left = room_left(text) if status == 400 else None
        if left is not None:
            status, text = self.post(f"{self.base_url}/chat/completions", body | {"max_tokens": left})
        if status != 200:
            raise RuntimeError(f"HTTP {status}: {text[:200]}")
        # a server that does not stream answers in one piece
        out = streamed(text) if stream and text.lstrip().startswith("data:") else json.loads(text)["choices"][0]["message"]["content"] or ""
        if self.known is not None:
            self.known[key] = out
        return out

    def _each(self, papers: list[dict], system: str, schema: dict, before: str = "") -> list[str]:
        """Answers in the papers' order, several at a time; an error ends the task, which is tried again."""

        def one(p: dict) -> str:
            keywords = ", ".join(p.get("author_keywords") or []) or "(none)"
            user = f"{before}TITLE: {p.get('title')}\n\nABSTRACT: {p.get('abstract') or '(none)'}\n\nKEYWORDS: {keywords}"
            return self.chat([{"role": "system", "content": system}, {"role": "user", "content": user}], schema)

        with ThreadPoolExecutor(self.concurrency) as pool:
            return list(pool.map(one, papers))

    def annotate(self, papers: list[dict]) -> list[str]:
        return self._each(papers, INSTRUCTION, json_schema())

    def label(self, papers: list[dict]) -> list[str]:
        """Labels of a closed list for each paper."""
        listed = "".join(f"- {x}\n" for x in self.labels)
        return self._each(papers, LABELLING, label_schema(self.labels), f"LABELS:\n{listed}\n")

    def narrate(self, facts_json: str, force: bool = False) -> str:
        """A report from the frozen facts; a second model may write another from the same."""
        system = "Write a markdown report on the publication trends in these facts. Every number must be one of theirs. Label counts overlap, as papers have several labels; totals are those of corpus_summary."
        return self.chat([{"role": "system", "content": system}, {"role": "user", "content": facts_json}], max_tokens=max(4096, self.max_tokens), stream=True, force=force)

    def name_topic(self, terms: list[str], titles: list[str]) -> dict:
        schema = {"type": "object", "properties": {"label": {"type": "string"}, "summary": {"type": "string"}}, "required": ["label", "summary"]}
        user = f"TERMS: {', '.join(terms)}\nTITLES:\n" + "\n".join(f"- {t}" for t in titles)
        raw = self.chat([{"role": "system", "content": "Name the topic in at most six words and sum it up in a sentence. JSON only."}, {"role": "user", "content": user}], schema)
        return json.loads(raw[raw.find("{") : raw.rfind("}") + 1])

    def health(self) -> bool:
        try:
            return self.post(f"{self.base_url}/models", None)[0] == 200
        except OSError:
            return False
