"""python -m siltlog PATH get K | put K V | delete K | write (put K V | delete K)... | scan [FROM [LIMIT]] | compact | status

Exit status: 0 done, 1 not found, 2 bad arguments, 3 any other error.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from .sources import Store, StoreError


def parse_batch(words: list[str]) -> list[tuple]:
    """The operations of a `write` command line."""
    out, rest = [], list(words)
    while rest:
        op = rest.pop(0)
        n = {"put": 2, "delete": 1}.get(op)
        if n is None or len(rest) < n:
            raise StoreError("InvalidArgument", f"can't read an operation from {op}")
        out.append((op, *rest[:n]))
        del rest[:n]
    return out


def run(store: Store, command: str, words: list[str]) -> int:
    if command == "get" and len(words) == 1:
        value = store.get(words[0])
        if value is None:
            return 1
        sys.stdout.buffer.write(value + b"\n")
    elif command in ("put", "delete"):
        store.write(parse_batch([command, *words]))
    elif command == "write" and words:
        store.write(parse_batch(words))
    elif command == "scan" and len(words) <= 2:
        for row in store.seek(words[0] if words else b"", int(words[1]) if len(words) == 2 else None).toLocalIterator():
            sys.stdout.buffer.write(bytes(row["k"]) + b"\t" + bytes(row["v"]) + b"\n")
    elif command == "compact" and not words:
        store.flush()
        store.compact()
    elif command == "status" and not words:
        print(json.dumps(store.stats()))
    else:
        raise StoreError("InvalidArgument", __doc__.splitlines()[0])
    return 0


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        with Store(spark, args[0]) as store:
            return run(store, args[1], args[2:])
    except StoreError as e:
        print(e, file=sys.stderr)
        return 2 if e.code == "InvalidArgument" else 3


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
