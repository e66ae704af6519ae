"""Engines behind HTTP: chat completions and jobs. The transport can be replaced, as tests do."""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable

from .recognition import Recogniser, register

#: (method, url, headers, body) -> (status, body)
Transport = Callable[[str, str, dict, bytes | None], tuple[int, bytes]]


def http(method: str, url: str, headers: dict, body: bytes | None, timeout: float = 180) -> tuple[int, bytes]:
    request = urllib.request.Request(url, body, headers, method=method)
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, answer.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()


def content(prompt: str, image: bytes, order: str = "image-first") -> list[dict]:
    """A message's parts, the image as a data URL."""
    text = {"type": "text", "text": prompt}
    picture = {"type": "image_url", "image_url": {"url": "data:image/png;base64," + base64.b64encode(image).decode()}}
    return [text, picture] if order == "text-first" else [picture, text]


def chat(options: dict) -> Recogniser:
    """An endpoint with OpenAI's chat form; every failure is the result's error."""
    send: Transport = options.get("transport") or http
    url, key = options["endpoint"].rstrip("/") + "/chat/completions", options.get("api_key") or ""
    most = options.get("max_tokens") or options.get("default_max_tokens", 4096)

    def read(image: bytes, prompt: str = "") -> tuple[str, dict]:
        parts = content(prompt or options.get("prompt", ""), image, options.get("message_order", "image-first"))
        body = {"messages": [{"role": "user", "content": parts}], "temperature": options.get("temperature", 0), "max_tokens": most}
        try:
            status, answer = send("POST", url, {"Authorization": f"Bearer {key}", "Content-Type": "application/json"}, json.dumps(body).encode())
            if status != 200:
                return "", {"error": f"HTTP {status}: {answer[:200].decode('utf-8', 'replace')}"}
            return json.loads(answer)["choices"][0]["message"]["content"], {}
        except (OSError, ValueError, KeyError, IndexError) as e:
            return "", {"error": f"{type(e).__name__}: {e}"}

    return read


def job(options: dict) -> Recogniser:
    """A service of jobs: submit, poll until done, failed or out of time, then fetch lines of JSON."""
    send: Transport = options.get("transport") or http
    endpoint, pause, longest = options["endpoint"].rstrip("/"), options.get("pause", 5.0), options.get("max_wait", 300.0)
    headers = {"Authorization": f"bearer {options.get('api_key') or ''}", "Content-Type": "application/json"}

    def read(image: bytes, prompt: str = "") -> tuple[str, dict]:
        form = {"model": options.get("model", ""), "optionalPayload": options.get("optional_payload", {}), "file": base64.b64encode(image).decode()}
        try:
            status, answer = send("POST", endpoint, headers, json.dumps(form).encode())
            number = json.loads(answer).get("data", {}).get("jobId") if status == 200 else None
        except (OSError, ValueError) as e:
            return "", {"error": f"submit: {e}"}
        if not number:
            return "", {"error": f"submit: HTTP {status}"}
        until, url = time.monotonic() + longest, None
        while url is None:
            if time.monotonic() >= until:
                return "", {"error": "timeout"}
            try:
                data = json.loads(send("GET", f"{endpoint}/{number}", headers, None)[1]).get("data", {})
            except (OSError, ValueError):
                data = {}  # a poll that fails is tried again
            if data.get("state") == "failed":
                return "", {"error": f"failed: {data.get('errorMsg')}"}
            if data.get("state") == "done":
                url = (data.get("resultUrl") or {}).get("jsonUrl")
                if not url:
                    return "", {"error": "done without a result"}
            else:
                time.sleep(pause)
        try:
            status, answer = send("GET", url, {}, None)
        except OSError as e:
            return "", {"error": f"result: {e}"}
        if status != 200:
            return "", {"error": f"result: HTTP {status}"}
        texts = []
        for line in filter(str.strip, answer.decode("utf-8", "replace").split("\n")):
            try:
                texts += [r["markdown"]["text"] for r in json.loads(line)["result"].get("layoutParsingResults", [])]
            except (ValueError, KeyError, TypeError):
                continue
        return ("\n\n".join(texts), {"job": number}) if texts else ("", {"error": "empty result"})

    return read


for _name in ("glm", "dsocr", "llama", "audit"):
    register(_name)(chat)
register("cloud")(job)
