"""A watcher that writes the changes of a repository's files as JSON events, for the change stream to read.

It compares listings (path, size, time), as a store without notifications allows nothing else. Every change starts one global
pause anew; after a pause without changes what is pending goes out as one file, the last change of each path.
What is pending is one entry a path. A file that exists when the events go out counts as upserted, whatever happened to it.
"""

from __future__ import annotations

import json
import logging
import os
import threading
import time
import uuid
from datetime import datetime, timezone

from .scan import list_sources

log = logging.getLogger(__name__)


class FolderWatcher:
    """Watches ``root`` and writes into ``out``; ``start`` and ``stop``, or a ``with`` block."""

    def __init__(self, root: str, out: str, pause: float = 5.0, interval: float = 0.5, include_dirs: tuple[str, ...] = ()):
        self.root, self.out, self.pause, self.interval, self.include_dirs = root, out, pause, interval, include_dirs
        self.known: dict[str, tuple] = {}
        self.pending: dict[str, str] = {}
        self._last, self._halt, self._thread = 0.0, threading.Event(), None

    def is_running(self) -> bool:
        return self._thread is not None and self._thread.is_alive()

    def start(self) -> "FolderWatcher":
        if self.is_running():
            log.warning("already watching %s", self.root)
            return self
        os.makedirs(self.out, exist_ok=True)
        self.known = self._listing()
        self._halt.clear()
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()
        return self

    def stop(self) -> None:
        """Stop within some seconds; what is pending goes out first."""
        self._halt.set()
        if self._thread is not None:
            self._thread.join(5)
            self._thread = None
        self.flush()

    def __enter__(self) -> "FolderWatcher":
        return self.start()

    def __exit__(self, *_) -> None:
        self.stop()

    def _listing(self) -> dict[str, tuple]:
        return {path: (size, at) for path, size, at in list_sources(self.root, self.include_dirs)}

    def _run(self) -> None:
        while not self._halt.wait(self.interval):
            try:
                self.poll()
            except OSError:
                log.exception("could not list %s", self.root)

    def poll(self, now: float | None = None) -> None:
        """Compare with the last listing; write what is pending if nothing changed for the pause."""
        now = time.monotonic() if now is None else now
        fresh = self._listing()
        changed = {p: "upsert" for p, mark in fresh.items() if self.known.get(p) != mark} | {p: "delete" for p in self.known.keys() - fresh.keys()}
        self.known = fresh
        if changed:
            self.pending |= changed
            self._last = now
        elif self.pending and now - self._last >= self.pause:
            self.flush()

    def flush(self) -> None:
        if not self.pending:
            return
        at = datetime.now(timezone.utc).isoformat()
        rows = [{"path": p, "change_type": "upsert" if p in self.known else "delete", "event_time": at} for p in sorted(self.pending)]
        self.pending = {}
        name = uuid.uuid4().hex
        with open(os.path.join(self.out, f".{name}"), "w", encoding="utf-8") as f:
            f.write("\n".join(map(json.dumps, rows)))
        os.rename(os.path.join(self.out, f".{name}"), os.path.join(self.out, f"{name}.json"))
