"""A small HTTP server that gives the usage metrics."""

from __future__ import annotations

import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

PATH = "/metrics"


def start_metrics_server(render: Callable[[], str], port: int, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """Serve ``render()`` at /metrics in a daemon thread; any other path is 404. Close with ``shutdown()``."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            found = self.path.split("?")[0] == PATH
            body = render().encode() if found else b"not found\n"
            self.send_response(200 if found else 404)
            self.send_header("Content-Type", "text/plain; version=0.0.4; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            if self.command == "GET":
                self.wfile.write(body)

        do_HEAD = do_GET  # noqa: N815

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
