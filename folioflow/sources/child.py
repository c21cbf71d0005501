"""The process that parses a worker's documents: some come in, the items or a code of each go out, until the worker is gone."""

from __future__ import annotations

import os
import pickle
import sys
import threading
import time

from .parse import extract


def send(body: bytes) -> None:
    sys.stdout.buffer.write(len(body).to_bytes(8, "little"))
    sys.stdout.buffer.write(body)
    sys.stdout.buffer.flush()


def leave_with(parent: int) -> None:
    """Ends this process when its worker has ended, even amid a document."""
    while os.getppid() == parent:
        time.sleep(1)
    os._exit(1)


if __name__ == "__main__":
    threading.Thread(target=leave_with, args=(os.getppid(),), daemon=True).start()
    send(b"")
    while head := sys.stdin.buffer.read(8):
        documents, limits = pickle.loads(sys.stdin.buffer.read(int.from_bytes(head, "little")))
        documents.reverse()
        while documents:
            out = extract(*documents.pop(), limits)
            send(pickle.dumps(out, protocol=5))
            del out
