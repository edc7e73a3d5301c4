"""Outside services as plain callables: extraction, transcription, embedding, reranking, plug-in programs. All are optional.

Each returns a function that runs inside Arrow batches on executors; tests put doubles in their place.
"""

from __future__ import annotations

import base64
import json
import os
import re
import subprocess
import sys
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator

from ..functions import text as T

#: Seconds that a plug-in may run; seconds between tries of a busy service; texts and characters that a reranker takes.
PLUGIN_SECONDS, WAITS, RERANK_TEXTS, RERANK_CHARS = 10, (1, 2, 4), 100, 5000


def _post(url: str, body: bytes, kind: str = "application/json", headers: dict | None = None, timeout: float = 60) -> dict:
    request = urllib.request.Request(url, body, {"Content-Type": kind} | (headers or {}))
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read())


def patient(call: Callable, waits: tuple[float, ...] = WAITS) -> Callable:
    """call, tried again after each wait while the service says that it is busy (503)."""

    def run(*args):
        for wait in (*waits, None):
            try:
                return call(*args)
            except urllib.error.HTTPError as e:
                if e.code != 503 or wait is None:
                    raise
                time.sleep(wait)

    return run


def multipart(name: str, data: bytes) -> tuple[bytes, str]:
    mark = uuid.uuid4().hex
    head = f'--{mark}\r\nContent-Disposition: form-data; name="file"; filename="{name}"\r\nContent-Type: application/octet-stream\r\n\r\n'
    return head.encode() + data + f"\r\n--{mark}--\r\n".encode(), f"multipart/form-data; boundary={mark}"


def extractor(url: str, ocr: bool = False) -> Callable[[str, bytes], str]:
    """Text of a document from an extraction service."""

    def run(path: str, data: bytes) -> str:
        body, kind = multipart(path.rsplit("/", 1)[-1], data)
        return _post(url + ("?ocr=true" if ocr else ""), body, kind)["text"]

    return run


def transcriber(url: str, least: int = 0, waits: tuple[float, ...] = WAITS, segments: bool = False) -> Callable[[str, bytes], str | tuple[str, None, dict]]:
    """Text of a recording; empty if it has fewer than ``least`` characters. With ``segments``, its timed parts (start, end, text) go into the metadata."""

    def run(path: str, data: bytes) -> str | tuple[str, None, dict]:
        body, kind = multipart(path.rsplit("/", 1)[-1], data)
        said = _post(url, body, kind, timeout=600)
        text = said.get("text", "")
        text = text if len(text.strip()) >= least else ""
        if not segments:
            return text
        timed = [{k: p.get(k) for k in ("start", "end", "text")} for p in said.get("segments") or []]
        return text, None, {"segments": timed} if text and timed else {}

    return patient(run, waits)


def embedder(provider: str, url: str, model: str, key: str | None = None, waits: tuple[float, ...] = WAITS) -> Callable[[list[str]], list[list[float]]]:
    """Vectors from a service by the form of its requests: openai (answers carry an index), ollama (one list) or gemini (one text each). A busy service is asked again."""
    headers = {"Authorization": f"Bearer {key}"} if key else {}

    def openai(texts: list[str]) -> list[list[float]]:
        rows = _post(url, json.dumps({"model": model, "input": texts}).encode(), headers=headers)["data"]
        out: list = [None] * len(texts)
        for r in rows:
            out[r["index"]] = r["embedding"]
        return out

    def ollama(texts: list[str]) -> list[list[float]]:
        return _post(url, json.dumps({"model": model, "input": texts}).encode(), headers=headers)["embeddings"]

    def gemini(texts: list[str]) -> list[list[float]]:
        # texts that were answered are not sent again when a later one finds the service busy
        one = patient(lambda t: _post(url, json.dumps({"model": model, "content": {"parts": [{"text": t}]}}).encode(), headers=headers), waits)
        return [one(t)["embedding"]["values"] for t in texts]

    known = {"openai": openai, "ollama": ollama, "gemini": gemini}
    if provider not in known:
        raise ValueError(f"provider must be one of {sorted(known)}, not {provider!r}")
    return known[provider] if provider == "gemini" else patient(known[provider], waits)


class Generator:
    """A language model behind a service: whole answers, JSON, or pieces as they come. provider: openai, ollama or gemini."""

    def __init__(self, provider: str, url: str, model: str, key: str | None = None, timeout: float = 120):
        if provider not in ("openai", "ollama", "gemini"):
            raise ValueError(f"provider must be openai, ollama or gemini, not {provider!r}")
        self.provider, self.url, self.model, self.timeout = provider, url, model, timeout
        self.headers = {"Authorization": f"Bearer {key}"} if key else {}

    def _body(self, prompt: str, json_mode: bool, stream: bool) -> bytes:
        if self.provider == "gemini":
            body: dict = {"contents": [{"role": "user", "parts": [{"text": prompt}]}]}
            if json_mode:
                body["generationConfig"] = {"responseMimeType": "application/json"}
        elif self.provider == "ollama":
            body = {"model": self.model, "prompt": prompt, "stream": stream} | ({"format": "json"} if json_mode else {})
        else:
            body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "stream": stream} | ({"response_format": {"type": "json_object"}} if json_mode else {})
        return json.dumps(body).encode()

    def _text(self, answer: dict) -> str:
        if self.provider == "gemini":
            return "".join(p.get("text", "") for c in answer.get("candidates", [])[:1] for p in c.get("content", {}).get("parts", []))
        if self.provider == "ollama":
            return answer.get("response", "")
        choice = (answer.get("choices") or [{}])[0]
        return (choice.get("message") or choice.get("delta") or {}).get("content") or ""

    def __call__(self, prompt: str) -> str:
        return self._text(_post(self.url, self._body(prompt, False, False), headers=self.headers, timeout=self.timeout))

    def json(self, prompt: str) -> dict:
        """The answer as JSON, with or without a code fence around it; an error if it is none."""
        said = self._text(_post(self.url, self._body(prompt, True, False), headers=self.headers, timeout=self.timeout)).strip()
        return json.loads(re.sub(r"^```(?:json)?\s*|\s*```$", "", said))

    def stream(self, prompt: str) -> Iterator[str]:
        """The answer piece by piece: lines of JSON, bare or as server-sent events."""
        request = urllib.request.Request(self.url, self._body(prompt, False, True), {"Content-Type": "application/json"} | self.headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            for line in answer:
                line = line.decode().strip().removeprefix("data:").strip()
                if line and line != "[DONE]" and (piece := self._text(json.loads(line))):
                    yield piece


def timed(pieces: Iterator[str], clock: Callable[[], float] = time.monotonic) -> Iterator[tuple[float, str]]:
    """Pieces of a stream with the seconds since it was asked for; the first is the time to the first token."""
    began = clock()
    for piece in pieces:
        yield clock() - began, piece


def sidecar(url: str, timeout: float = PLUGIN_SECONDS) -> Callable[[str, bytes], tuple[str, list[dict]]]:
    """A plug-in behind HTTP: path and content (base64) go in as JSON; text, and relations if it finds any, come out."""

    def run(path: str, data: bytes) -> tuple[str, list[dict]]:
        said = _post(url, json.dumps({"path": path, "content": base64.b64encode(data).decode()}).encode(), timeout=timeout)
        if said.get("error"):
            raise ValueError(said["error"])
        return said.get("text", ""), said.get("relations") or []

    return run


def reranker(url: str | None, waits: tuple[float, ...] = WAITS) -> Callable[[str, list[str]], list[float]]:
    """Scores of texts for a query; zeros without a service. The service takes RERANK_TEXTS texts a call, and the first RERANK_CHARS characters of each.

    A busy service is asked again, for the block that it refused only.
    """
    send = patient(lambda body: _post(url, body, timeout=5), waits)

    def run(question: str, texts: list[str]) -> list[float]:
        if url is None or not texts:
            return [0.0] * len(texts)
        out = [0.0] * len(texts)
        for begin in range(0, len(texts), RERANK_TEXTS):
            sent = [t[:RERANK_CHARS] for t in texts[begin : begin + RERANK_TEXTS]]
            for r in send(json.dumps({"query": question, "texts": sent}).encode())["results"]:
                out[begin + r["index"]] = float(r["score"])
        return out

    return run


def program(path: str, seconds: float = PLUGIN_SECONDS) -> Callable[[str, bytes], str | tuple[str, list[dict]]]:
    """A plug-in program: file name and content go in as JSON; text, and relations if it finds any, come out as JSON. It is ended after ``seconds``."""

    def run(name: str, data: bytes) -> str | tuple[str, list[dict]]:
        given = json.dumps({"path": name, "content": base64.b64encode(data).decode()})
        done = subprocess.run([sys.executable, path], input=given, capture_output=True, text=True, timeout=seconds, check=True)
        said = json.loads(done.stdout)
        return (said["text"], said["relations"]) if said.get("relations") else said["text"]

    return run


def discover(folder: str) -> list[tuple[str, tuple[str, ...], Callable[[str, bytes], str]]]:
    """The plug-ins of a folder, in order of their file names, as ``files.extract`` takes them: the first that takes an extension wins."""
    found = []
    for name in sorted(os.listdir(folder) if os.path.isdir(folder) else []):
        if not name.endswith(".py"):
            continue
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            head = [next(f, "").strip() for _ in range(30)]
        meta = {k: line.split(":", 1)[1].strip() for line in head for k in ("name", "extensions") if line.startswith(f"# {k}:")}
        exts = tuple(e.strip().lower() for e in meta.get("extensions", "").split(",") if e.strip())
        found.append((meta.get("name", name), exts, program(os.path.join(folder, name))))
    return found


def captioned(vision: Callable[[str, bytes], str], most: int | None = None) -> Callable[[str, bytes], tuple[str, None, dict]]:
    """A caption from a vision model, with how it was made as metadata; images over ``most`` bytes are not sent and have an empty text."""

    def run(path: str, data: bytes) -> tuple[str, None, dict]:
        if most is not None and len(data) > most:
            return "", None, {"skipped": "size"}
        return vision(path, data), None, {"extraction_method": "vision"}

    return run


def media_extractors(document: Callable | None = None, speech: Callable | None = None, vision: Callable | None = None, ocr: Callable | None = None, vision_most: int | None = None) -> list[tuple[str, tuple[str, ...], Callable]]:
    """Extractors by kind of file, of those services that there are; images prefer vision, up to ``vision_most`` bytes, to OCR."""
    out = [("speech", T.AUDIO + T.VIDEO, speech)] if speech else []
    if vision or ocr:
        out.append(("image", T.IMAGES, captioned(vision, vision_most) if vision else ocr))
    if document:
        out.append(("document", (".pdf", ".docx", ".doc", ".odt", ".rtf", ".pptx", ".xlsx", ".epub", ".html"), document))
    return out
