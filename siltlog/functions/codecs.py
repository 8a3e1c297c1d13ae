"""Column expressions that encode and decode keys, numbers, states and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers of states in replies, and names of states.
REPLY_CODES = {"OK": 1, "NotFound": 2, "InvalidArgument": 3, "IOError": 4, "Corruption": 5}
#: Bytes that an internal key has after the user's.
TRAILER = 9


def _turned(digits: Column, width: int) -> Column:
    """Hexadecimal digits with their pairs in the opposite order."""
    return F.concat(*[F.substring(digits, i + 1, 2) for i in range(2 * width - 2, -1, -2)])


def encode_fixed(number: Column, width: int) -> Column:
    """A number that isn't negative as `width` bytes (4 or 8), little-endian; null if it doesn't fit."""
    digits = F.hex(number.cast("long"))
    fits = (number >= 0) & (F.length(digits) <= 2 * width)
    return F.when(fits, F.unhex(_turned(F.lpad(digits, 2 * width, "0"), width)))


def decode_fixed(data: Column, width: int) -> Column:
    """The number of `width` little-endian bytes; null for other lengths, and above the highest long."""
    value = F.conv(_turned(F.hex(data), width), 16, 10).cast("decimal(20,0)")
    return F.when((F.octet_length(data) == width) & (value <= (1 << 63) - 1), value.cast("long"))


def internal_key(key: Column, sequence: Column) -> Column:
    """Bytes whose order is that of the key and then of falling sequences: the key, a zero byte, the inverted sequence in eight big-endian bytes."""
    return F.concat(key.cast("binary"), F.lit(b"\x00"), F.unhex(F.lpad(F.hex(F.bitwise_not(sequence.cast("long"))), 16, "0")))


def user_key(data: Column) -> Column:
    """The key of internal_key(); null if the bytes are too short or lack the zero byte."""
    size = F.octet_length(data) - TRAILER
    return F.when(_sound(data), F.substring(data, F.lit(1), size))


def key_sequence(data: Column) -> Column:
    """The sequence of internal_key(); null as for user_key(), and above the highest long."""
    number = F.conv(F.hex(F.substring(data, F.octet_length(data) - 7, F.lit(8))), 16, 10).cast("decimal(20,0)")
    inverted = F.lit(str((1 << 64) - 1)).cast("decimal(20,0)") - number
    return F.when(_sound(data) & (inverted <= (1 << 63) - 1), inverted.cast("long"))


def _sound(data: Column) -> Column:
    return (F.octet_length(data) >= TRAILER) & (F.hex(F.substring(data, F.octet_length(data) - 8, F.lit(1))) == "00")


def quoted(text: Column) -> Column:
    """text in double quotes, with a backslash ahead of quotes and backslashes in it."""
    return F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\])', r"\\$1"), F.lit('"'))


def unquoted(text: Column) -> Column:
    """What quoted() was given; null for other strings."""
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    return F.when(text.rlike(r'(?s)^"(?:[^"\\]|\\.)*"$'), F.regexp_replace(inner, r"(?s)\\(.)", "$1"))


def reply_code(state: Column) -> Column:
    """The number of a state's name; any other state is an IOError."""
    known = F.create_map(*[F.lit(x) for pair in REPLY_CODES.items() for x in pair])
    return F.coalesce(known[state], F.lit(REPLY_CODES["IOError"]))


def reply_state(code: Column) -> Column:
    """The state of a number; any other number is a Corruption."""
    known = F.create_map(*[F.lit(x) for name, n in REPLY_CODES.items() for x in (n, name)])
    return F.coalesce(known[code], F.lit("Corruption"))


def endpoint(text: Column) -> Column:
    """struct(host, port) of an IPv4 address and a port from 1 to 65535; null for anything else."""
    part = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    pattern = rf"^({part}(?:\.{part}){{3}}):(\d{{1,9}})$"
    port = F.regexp_extract(text, pattern, 2)
    number = F.when(port != "", port.cast("int"))
    return F.when(number.between(1, 65535), F.struct(F.regexp_extract(text, pattern, 1).alias("host"), number.alias("port")))


def cluster_identity(name: Column, node: Column, clients: Column, peers: Column) -> Column:
    """What a node's state is bound to: the cluster, the node and the addresses of all nodes, a line each."""
    pairs = F.zip_with(clients, peers, lambda c, p: F.concat(c, F.lit(" "), p))
    return F.concat(name, F.lit("\n"), node.cast("string"), F.lit("\n"), F.array_join(pairs, "\n"))


def log_offset(index: Column, snapshot_index: Column) -> Column:
    """Place of an entry among those that follow the snapshot; null for entries that it has."""
    return F.when(index > snapshot_index, index - snapshot_index - 1)
