"""Content-keyed coordinates, fingerprints and seeds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, functions as F


def unit_coordinate(*parts: Column | str) -> Column:
    """A number in [0, 1) from the parts joined by ``|``: the first 8 bytes of their SHA-1, big-endian, over 2 ** 64.

    Strings are constants. The decimal step keeps all 64 bits unsigned.
    """
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    head = F.conv(F.substring(F.sha1(F.concat_ws("|", *columns)), 1, 16), 16, 10)
    return head.cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def acceptance_coordinate(text: Column, domain: str) -> Column:
    """The coordinate that decides on subsamples; keyed by the text."""
    return unit_coordinate(domain, text)


def split_coordinate(source_id: Column, seed: int, domain: str) -> Column:
    """The coordinate that decides on train or test; keyed by the id as text, so 42 and "42" agree."""
    return unit_coordinate(domain, str(seed), source_id)


def bootstrap_seed(key: str) -> int:
    """The low 32 bits of BLAKE2b-64 of a key."""
    return int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "big") & 0xFFFFFFFF


def shard_fingerprint(digests: Iterable[str]) -> str:
    """BLAKE2b-128 of sorted shard digests, a line each; without any, an error."""
    lines = sorted(digests)
    if not lines:
        raise ValueError("no shards")
    return hashlib.blake2b("".join(f"{x}\n" for x in lines).encode(), digest_size=16).hexdigest()


def content_fingerprint(rows: "DataFrame") -> Column:  # noqa: F821
    """An aggregate over a table's rows that doesn't depend on their order or files: count, and two sums of row hashes."""
    row = F.struct(*[F.col(c) for c in rows.columns])
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), F.to_json(row)).cast("decimal(38,0)")).cast("string")
    return F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), total(1), total(2)), 256)
