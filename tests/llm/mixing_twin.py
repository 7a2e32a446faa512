"""The mix in plain Python: one list per step, no parts, buckets only as an order."""

from __future__ import annotations

import re
from collections import Counter

import xxhash

from tessera.llm import mixing


def h(*values) -> int:
    """Spark's xxhash64; a 32-bit number is a tuple of one."""
    seed = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
            seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def permuted(index: int, a: int, b: int, keys: tuple, seed: int) -> int:
    x, y = index % a, index // a
    for r in range(4):
        x = (x + h(y, (2 * r + seed,), *keys) % a) % a
        y = (y + h(x, (2 * r + 1 + seed,), *keys) % b) % b
    return x + a * y


def targets(sizes: list[int], weights=(3, 1, 2), total=1.5, most=2.0) -> list[float]:
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    free, level = set(range(len(sizes))), 0.0
    while free:
        level = (total * sum(sizes) - most * sum(s for k, s in enumerate(sizes) if k not in free)) / sum(weight[k] for k in free)
        over = {k for k in free if most * sizes[k] <= weight[k] * level}
        if not over:
            break
        free -= over
    return [weight[k] * level if k in free else most * s for k, s in enumerate(sizes)]


def taken(rows: list[tuple], shard_slots: int) -> tuple[list[tuple], Counter]:
    """``doc_id, size, source_size, target, taken`` for rows ``doc_id, text, source``, and slots by shard and source."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    buckets = int(len(rows) ** 0.5) + 1
    own = [[k for k, r in enumerate(rows) if r[2] == s] for s in sources]
    for mine in own:
        mine.sort(key=lambda k: (h(rows[k][0], h(rows[k][1])) % buckets, rows[k][0] is not None, rows[k][0] or 0, h(rows[k][1])))
    total = [sum(size[k] for k in mine) for mine in own]
    want = targets(total)
    figures = []
    for n_words, target in zip(total, want, strict=True):
        wanted = max(1.0, n_words / max(1.0, min(float(mixing.BLOCK), float(n_words // mixing.LEAST_BLOCKS))))
        a = int(wanted**0.5)
        b = max(1, int(wanted / a))
        figures.append((a, b, round(target * a * b / n_words) if n_words else 0))
    n_slots = sum(f[2] for f in figures)
    shards = max(1, -(-n_slots // shard_slots))
    length = max(1, -(-n_slots // shards))
    drawn, ticket = Counter(), 0
    for k, f in enumerate(figures):
        for _ in range(f[2]):
            drawn[permuted(ticket, shards, length, (), mixing.SEED + 100) % shards, k] += 1
            ticket += 1
    got = Counter()
    for k, (a, b, _) in enumerate(figures):
        words = [d for d in own[k] for _ in range(size[d])]
        q, r = divmod(total[k], a * b)
        slot = 0
        for shard in range(shards):
            for _ in range(drawn[shard, k]):
                block = permuted(slot % (a * b), a, b, (k + 1, slot // (a * b)), mixing.SEED)
                begin = block * q + min(block, r)
                got.update(words[begin : begin + q + (block < r)])
                slot += 1
    source = {s: k for k, s in enumerate(sources)}
    return [(d, size[k], total[source[s]], want[source[s]], got[k]) for k, (d, _, s) in enumerate(rows)], drawn
