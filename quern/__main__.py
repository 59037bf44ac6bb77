"""The engine from the command line: ``python -m quern index``, ``search``, ``callers``, ``calls``, ``chain``, ``hierarchy``, ``status``, ``reindex``, ``watch``.

Settings come from the environment (see ``config``) or ``--repo`` and ``--state``; answers are printed as JSON.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
import time

from .config import Settings
from .engine import Engine
from .session import local_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quern", description="Index a repository of source code and ask it.")
    p.add_argument("--repo", default=os.environ.get("REPO_PATH", "."))
    p.add_argument("--state", default=os.environ.get("STORAGE_PATH"))
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("index")
    commands.add_parser("status")
    commands.add_parser("watch")
    for name, argument in (("calls", "id"), ("callers", "id"), ("hierarchy", "id")):
        commands.add_parser(name).add_argument(argument)
    chain = commands.add_parser("chain")
    chain.add_argument("id")
    chain.add_argument("--depth", type=int, default=5)
    chain.add_argument("--direction", choices=("outgoing", "incoming"), default="outgoing")
    search = commands.add_parser("search")
    search.add_argument("query")
    search.add_argument("--limit", type=int, default=5)
    search.add_argument("--type")
    search.add_argument("--prefix")
    again = commands.add_parser("reindex")
    again.add_argument("path", nargs="?")
    again.add_argument("--full", action="store_true")
    again.add_argument("--force", action="store_true")
    return p


def answer(engine: Engine, a: argparse.Namespace) -> dict:
    """What one command gives."""
    return {
        "index": lambda: engine.index(), "status": lambda: engine.get_index_status(), "calls": lambda: engine.get_function_calls(a.id), "callers": lambda: engine.get_callers(a.id),
        "hierarchy": lambda: engine.get_class_hierarchy(a.id), "chain": lambda: engine.get_call_chain(a.id, a.depth, a.direction),
        "search": lambda: engine.semantic_search(a.query, a.limit, a.type, a.prefix), "reindex": lambda: engine.reindex(a.path, a.full, a.force)}[a.command]()


def main(arguments: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(arguments)
    settings = Settings.from_environment(repo_path=a.repo, **({"storage_path": a.state} if a.state else {}))
    logging.basicConfig(level=settings.log_level, format="%(asctime)s %(name)s %(levelname)s %(message)s", stream=sys.stderr)
    with Engine(spark or local_session("quern"), settings) as engine:
        if a.command == "watch":
            engine.index(reconcile=True)
            engine.watch_repository()
            try:
                while engine.query.isActive:
                    time.sleep(1)
            except KeyboardInterrupt:
                pass
            return 0
        print(json.dumps(answer(engine, a), default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
