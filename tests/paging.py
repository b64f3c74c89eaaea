"""Page readers that tests name: newest first by cursor, and a growing list that a cursor follows; calls are counted in a folder."""

import os

COUNTS = "/tmp/tidemark-paging"


def uid(ms: int) -> str:
    h = f"{ms:012x}"
    return f"{h[:8]}-{h[8:]}-7000-8000-000000000000"


def called(what: str) -> None:
    os.makedirs(COUNTS, exist_ok=True)
    with open(f"{COUNTS}/calls", "a") as f:
        f.write(what + "\n")


def newest(cursor, size):
    at = int(cursor or 0)
    called(f"newest {at}")
    ids = list(range(10_000, 0, -10))[at : at + size]
    return [{"id": uid(i), "n": i} for i in ids], str(at + size) if at + size < 1000 else None


def growing(cursor, size):
    with open(f"{COUNTS}/items") as f:
        items = f.read().split()
    at = int(cursor or 0)
    called(f"growing {at}")
    page = items[at : at + size]
    return [{"id": uid(int(x)), "n": int(x)} for x in page], str(at + len(page))
