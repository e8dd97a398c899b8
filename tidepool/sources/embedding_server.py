"""An embedding service on this machine, for tests and trials: the same endpoints, limits and payloads, hashed vectors for a model."""

from __future__ import annotations

import base64
import hashlib
import json
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np

from tidepool.schema import EMBED_BATCH

Model = Callable[[bytes], np.ndarray]  # what to embed -> one vector for each token or patch


def hashed_vectors(content: bytes, dim: int = 16) -> np.ndarray:
    """A stand-in for a model: a vector of signs for each white-space word, or each 64 bytes where there is no text."""
    try:
        parts = content.decode().split() or [content]
    except UnicodeDecodeError:
        parts = [content[a : a + 64] for a in range(0, len(content), 64)]
    digests = [hashlib.sha256(p if isinstance(p, bytes) else p.lower().encode()).digest()[:dim] for p in parts]
    return np.array([[1.0 if b % 2 else -1.0 for b in d] for d in digests])


class _Refused(Exception):
    """What the caller sent can't be embedded."""


class _Unknown(Exception):
    """No such endpoint."""


def _text(value: object) -> bytes:
    if not isinstance(value, str) or not value.strip():
        raise _Refused("a query must not be blank")
    return value.encode()


class EmbeddingServer:
    """Answers GET /health and POST /embed_image, /embed_query, /embed_queries on a free port until closed."""

    def __init__(self, model: Model = hashed_vectors, most: int = EMBED_BATCH) -> None:
        def payload(content: bytes) -> dict:
            m = np.asarray(model(content), np.float16)
            return {"shape": list(m.shape), "embedding_b64": base64.b64encode(m.tobytes()).decode()}

        def answer(path: str, body: dict) -> dict:
            if path == "/embed_query":
                return payload(_text(body.get("query")))
            if path == "/embed_image":
                return payload(base64.b64decode(body["image_b64"]))
            if path == "/embed_queries":
                if not 0 < len(body["queries"]) <= most:
                    raise _Refused(f"from 1 to {most} queries a call")
                return {"embeddings": [payload(_text(q)) for q in body["queries"]]}
            raise _Unknown(path)

        class Handler(BaseHTTPRequestHandler):
            def _send(self, code: int, body: dict) -> None:
                data = json.dumps(body).encode()
                self.send_response(code)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def do_GET(self) -> None:  # noqa: N802
                self._send(*((200, {"status": "ok"}) if self.path == "/health" else (404, {})))

            def do_POST(self) -> None:  # noqa: N802
                try:
                    self._send(200, answer(self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
                except _Unknown:
                    self._send(404, {})
                except (_Refused, ValueError, TypeError, KeyError) as e:
                    self._send(400, {"error": str(e)})

            def log_message(self, *_: object) -> None:
                pass

        self._server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self._server.server_address[1]}"
        threading.Thread(target=self._server.serve_forever, daemon=True).start()

    def __enter__(self) -> EmbeddingServer:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        self._server.shutdown()
        self._server.server_close()
