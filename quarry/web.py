"""HTTP routes over ``api.Service``, with what Python has: JSON in and out, one thread for each request.

Who asks is told by the cookie ``session``, looked up in the store; signing in is left to the application.
A parameter out of its bounds is answered by 422, an unknown document or route by 404.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from http.cookies import SimpleCookie
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from quarry.api import LARGEST_PAGE, Service

FILTERS = ("mode", "site", "filetype", "section", "category")


class Invalid(ValueError):
    """A parameter that is missing or out of its bounds."""


@dataclass
class Request:
    """Parameters of the url or fields of the body, and the user."""

    values: dict
    user_id: int | None = None

    def text(self, name: str, default: str | None = None) -> str:
        value = self.values.get(name, default)
        if value is None:
            raise Invalid(f"{name} is missing")
        return str(value)

    def number(self, name: str, default, least, most, kind: type = int):
        try:
            value = kind(self.values.get(name, default))
        except (TypeError, ValueError):
            raise Invalid(f"{name} is no number") from None
        if not least <= value <= most:
            raise Invalid(f"{name} is {least} to {most}")
        return value

    def filters(self) -> dict:
        return {k: self.values[k] for k in FILTERS if self.values.get(k)}


def routes(service: Service) -> dict[tuple[str, str], Callable[[Request], object]]:
    """(method, path) to what answers it."""
    def search(r: Request):
        page, size = r.number("page", 1, 1, 10**9), r.number("size", 10, 1, LARGEST_PAGE)
        return service.search(r.text("q", ""), r.user_id, page=page, size=size, **r.filters())

    def signed_in(r: Request) -> int:
        if r.user_id is None:
            raise PermissionError("no session")
        return r.user_id

    return {
        ("GET", "/api/search"): search,
        ("GET", "/api/facets"): lambda r: service.facets(r.text("q", ""), **r.filters()),
        ("GET", "/api/suggest"): lambda r: service.suggest(r.text("q", ""), r.user_id, r.number("limit", 10, 1, 50)),
        ("GET", "/api/stats"): lambda r: service.stats(),
        ("GET", "/api/topics"): lambda r: service.topics(),
        ("GET", "/api/crawl-plan"): lambda r: service.crawl_plan(r.number("scale_factor", 1.0, 0.01, 20, float)),
        ("GET", "/api/history"): lambda r: service.history(r.user_id, r.number("limit", 100, 1, 1000)),
        ("GET", "/api/pipeline"): lambda r: [{"name": n, "about": a} for n, a in service.pipeline()],
        ("GET", "/api/health"): lambda r: service.health(),
        ("GET", "/health"): lambda r: service.health(),
        ("POST", "/api/click"): lambda r: service.click(r.text("doc_id"), r.text("url"), r.text("title", ""), r.user_id) or {"status": "ok"},
        ("POST", "/api/profile"): lambda r: service.profile(signed_in(r), r.text("interests", "")) or {"status": "ok"},
    }


def answer(service: Service, method: str, target: str, body: bytes = b"", session: str | None = None) -> tuple[int, str, bytes]:
    """(status, content type, body) of a request."""
    url = urlsplit(target)
    if method == "GET" and url.path.startswith("/snapshot/"):
        html = service.snapshot(unquote(url.path.removeprefix("/snapshot/")))
        return (200, "text/html; charset=utf-8", html.encode()) if html is not None else _json(404, {"detail": "no such document"})
    run = routes(service).get((method, url.path))
    if run is None:
        return _json(404, {"detail": "no such route"})
    try:
        values = {k: v[-1] for k, v in parse_qs(url.query, keep_blank_values=True).items()} if method == "GET" else json.loads(body or b"{}")
        if not isinstance(values, dict):
            raise Invalid("the body is no object")
        return _json(200, run(Request(values, service.user_of(session))))
    except PermissionError as e:
        return _json(401, {"detail": str(e)})
    except ValueError as e:  # of a bound, or no JSON
        return _json(422, {"detail": str(e)})


def _json(status: int, value) -> tuple[int, str, bytes]:
    return status, "application/json", json.dumps(value, ensure_ascii=False, default=str).encode()


def server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _serve(self):
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            cookie = SimpleCookie(self.headers.get("Cookie", "")).get("session")
            status, kind, out = answer(service, self.command, self.path, body, cookie.value if cookie else None)
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(out)))
            self.send_header("Content-Security-Policy", "sandbox")  # snapshots are pages of strangers
            self.end_headers()
            self.wfile.write(out)

        do_GET = do_POST = _serve

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer((host, port), Handler)
